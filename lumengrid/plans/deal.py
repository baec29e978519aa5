"""Rows dealt to tasks by what they cost."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose costs differ by less than this factor count as equal.
STEP = 1.25


def dealt(rows: DataFrame, cost: Column, parts: int | None = None) -> DataFrame:
    """The same rows in `parts` partitions (default: two for each core) of nearly equal total cost, by one shuffle.

    Rows are classed by the logarithm of their cost, the costly ones first, and each class is dealt in turn to all
    partitions, going on where the class before ended: partitions differ by one row of each class at most. Where a
    partition's share of a class begins follows from how many rows of each class the partitions hold, which is all
    that reaches the driver: a number for each partition and class. If rows arrive otherwise than when they were
    counted, they are dealt less evenly.
    """
    parts = parts or 2 * rows.sparkSession.sparkContext.defaultParallelism
    level = F.coalesce(F.floor(F.log(cost) / F.log(F.lit(STEP))), F.lit(0)).cast("int")
    classed = rows.withColumn("__class", level)
    counts = classed.groupBy(F.spark_partition_id().alias("part"), "__class").count().collect()
    begins, upto = {}, 0
    for c in sorted(counts, key=lambda r: (-r["__class"], r["part"])):
        begins[c["part"], c["__class"]] = upto
        upto += c["count"]
    schema = T.StructType([*classed.schema, T.StructField("__to", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, next_ = TaskContext.get().partitionId(), {}
        for batch in batches:
            to = []
            for c in batch.column(batch.schema.get_field_index("__class")).to_pylist():
                next_[c] = next_.get(c, begins.get((part, c), 0)) + 1
                to.append((next_[c] - 1) % parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.int32())], names=schema.names)

    return classed.mapInArrow(run, schema).repartitionById(parts, F.col("__to")).drop("__class", "__to")
