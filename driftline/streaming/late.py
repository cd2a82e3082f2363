"""Late points by a mark per sensor that may go back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS = T.StructType([T.StructField("sensor", T.StringType()), T.StructField("msg", T.LongType()), T.StructField("last", T.LongType())])


def marks(points: DataFrame) -> DataFrame:
    """(sensor, msg, last): the mark that a message's points (sensor, msg, begin_ns, t_ns) must pass.

    After a message the mark is its newest accepted time, or its begin if it had none:
    so it can regress, and no window function or watermark has it. A message accepts
    something if and only if its newest point passes, so one row per message decides;
    those rows are read in order, in a stream, with one number per sensor kept.
    """
    per_message = points.groupBy("sensor", "msg").agg(F.min("begin_ns").alias("b"), F.max("t_ns").alias("m"))
    ordered = per_message.repartition("sensor").sortWithinPartitions("sensor", "msg")

    def run(batches):
        now, last = object(), None
        for batch in batches:
            out = []
            for sensor, msg, begin, newest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sensor != now:
                    now, last = sensor, begin
                out.append((sensor, msg, last))
                last = newest if newest > last else begin
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], MARKS.fieldNames())

    return ordered.mapInArrow(run, MARKS)


def drop_late(points: DataFrame) -> DataFrame:
    return points.join(marks(points), ["sensor", "msg"]).where("t_ns > last").drop("last")
