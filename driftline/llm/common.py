"""Helpers shared by the text operators: table access, Arrow maps, lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Rows of which a task holds Python objects at once.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share: the one the session names in
    spark.checkpoint.dir, or, on a local master without one, a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="driftline-ckpt-"))
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def arrow_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: T.StructType,
    make: Callable[[], Callable[..., Iterable[pa.Array]]],
    carry: list[str] | None = None,
) -> DataFrame:
    """Adds columns computed batch by batch from Arrow arrays.

    make() runs once per task and returns a function from the input arrays to the
    output arrays. carry names the columns that stay (all by default); an output
    column replaces an input column of the same name.
    """
    made = {f.name.lower() for f in outputs.fields}
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in made]
    src = df.select(*[_quoted(c) for c in dict.fromkeys([*kept, *inputs])])
    schema = T.StructType([src.schema[c] for c in kept] + outputs.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                new = list(work(*[batch.column(c) for c in inputs]))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + new, schema.fieldNames())

    return src.mapInArrow(run, schema)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in column.to_pylist()]


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])
