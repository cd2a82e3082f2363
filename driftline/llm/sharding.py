"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows fall into blocks by a hash. For each block the number of rows that go to each
cell (a slice of a shard) is drawn beforehand from the multivariate hypergeometric
law, as a uniform permutation of all rows would give it. Then each block is put in
random order and dealt by these counts, rows are exchanged, and each cell is put in
random order again. Shard sizes, cell sizes and so the slots are known in advance:
no shard is ever gathered in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import cut_lineage

#: Bounds on blocks and cells: the driver draws at most their product of counts. Blocks are a power of two.
MAX_BLOCKS, MAX_CELLS = 2048, 2048
#: Borders compared at each step of the search for a row's cell.
FAN = 8


def _one_draw(rng: np.random.Generator, good: int, total: int, n: int) -> int:
    """How many of n drawn from total are of the `good`: inversion around the mode.

    Masses beyond 40 standard deviations are under the smallest double.
    """
    lo, hi = max(0, n - (total - good)), min(n, good)
    if lo >= hi:
        return lo
    mode = min(hi, max(lo, int((n + 1) * (good + 1) / (total + 2))))
    sd = (n * (good / total) * (1 - good / total) * (total - n) / max(1, total - 1)) ** 0.5
    a, b = max(lo, mode - int(40 * sd) - 40), min(hi, mode + int(40 * sd) + 40)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(total - good - n + k + 1)
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def communication_matrix(block_rows: list[int], cell_rows: list[int], seed: int) -> list[list[int]]:
    """Counts by block and cell with these exact margins, as a uniform permutation has them."""
    rng = np.random.default_rng(seed)
    left = np.array(cell_rows, np.int64)
    out = []
    for n in block_rows:
        if left.sum() < 10**9:
            row = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:
            row, rest, total = np.zeros(len(left), np.int64), n, int(left.sum())
            for j, m in enumerate(left.tolist()):
                row[j] = _one_draw(rng, m, total, rest)
                rest, total = rest - int(row[j]), total - m
        left -= row
        out.append(row.tolist())
    return out


def _even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def uniform_shards(
    rows: DataFrame,
    key: list[Column],
    shards: int = 24,
    rows_per_block: int = 1024,
    seed: int = 20,
    tie: list[Column] | None = None,
) -> DataFrame:
    """rows with `shard` (0 to shards - 1) and `slot` (0 up, without gaps, in each shard).

    Every assignment of the rows to places is equally likely, up to the quality of the
    hash; shard sizes differ by one at most. key: columns whose hash orders the rows;
    rows with equal keys are told apart by `tie`, and rows equal in both are
    interchangeable, so a lost task is repeated with the same result. Nulls are values
    like others. Fewer rows than shards leave some shards empty; no rows give none.
    Columns of rows named shard or slot are replaced; others stay.

    Plan: one aggregation of `key` for the block sizes, then two exchanges of the rows.
    The driver holds MAX_BLOCKS x MAX_CELLS counts at most, whatever the input. A row
    finds its cell among the borders of its block in logarithmic steps.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    names = rows.columns
    hash_of = lambda salt: F.xxhash64(F.lit(f"{seed}-{salt}"), *key)
    fine = F.pmod(hash_of("block"), F.lit(MAX_BLOCKS)).cast("int")
    found = {r[0]: r[1] for r in rows.groupBy(fine.alias("b")).agg(F.count("*")).collect()}  # MAX_BLOCKS rows at most
    total = sum(found.values())
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * rows_per_block < total:
        blocks *= 2
    sizes = [sum(found.get(b, 0) for b in range(k, MAX_BLOCKS, blocks)) for k in range(blocks)]
    per_shard = max(1, min(MAX_CELLS // shards, -(-total // (shards * rows_per_block))))
    cells = [(s, start, n) for s, m in enumerate(_even(total, shards)) for start, n in _starts(_even(m, per_shard))]
    matrix = communication_matrix(sizes, [n for _, _, n in cells], seed)
    levels = _levels(len(cells))
    ends = _small(
        spark,
        [(b, *[at[step - 1 :: step] for step in levels]) for b, row in enumerate(matrix) for at in [np.cumsum(row).tolist()]],
        ", ".join(["__b int", *[f"__ends{step} array<bigint>" for step in levels]]),
    )
    cell = _small(spark, [(i, s, start) for i, (s, start, _) in enumerate(cells)], "__c int, shard int, __start bigint")
    first = Window.partitionBy("__b").orderBy("__o", *(tie or []))
    again = Window.partitionBy("__c").orderBy("__p", *(tie or []))
    dealt = (
        rows.select("*", (fine % blocks).alias("__b"), hash_of("first").alias("__o"), hash_of("second").alias("__p"))
        .withColumn("__r", F.row_number().over(first))
        .join(ends, "__b")
        .withColumn("__c", F.lit(0))
    )
    for step in levels:  # borders before the row, among every step-th one
        dealt = dealt.withColumn("__c", F.expr(f"__c * {FAN} + size(filter(slice(__ends{step}, __c * {FAN} + 1, {FAN}), e -> e < __r))"))
    dealt = dealt.drop(*[f"__ends{step}" for step in levels], "__b", "__o", "__r")
    return (
        dealt.withColumn("__r", F.row_number().over(again))
        .join(cell, "__c")
        .select(*names, "shard", (F.col("__start") + F.col("__r") - 1).cast("long").alias("slot"))
    )


def _levels(n: int) -> list[int]:
    """Strides of the search among n borders, from coarse to 1: at each, FAN borders at most are compared."""
    step, out = 1, [1]
    while n // step > FAN:
        step *= FAN
        out.insert(0, step)
    return out


def _starts(sizes: list[int]) -> list[tuple[int, int]]:
    at, out = 0, []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def _small(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, T._parse_datatype_string(schema))


def shard_documents(docs: DataFrame, shards: int = 24, rows_per_block: int = 1024, seed: int = 20) -> DataFrame:
    """Per row of documents: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 8. Law `rows`: shard row counts are
    at most one apart. grown_shard is null under this law. Null ids and texts are
    values like others. Rows that share a doc_id are told apart by text_crc32 and size;
    only rows equal in all three, which are interchangeable, stay in one block. Texts
    are read once, whole: what is placed are these three numbers, from the checkpoint.
    """
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = uniform_shards(cut_lineage(narrow), [F.col(c) for c in ("doc_id", "text_crc32", "size")], shards, rows_per_block, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
