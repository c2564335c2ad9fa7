"""Places in an order within groups, however large one group is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.operators.sizes import broadcast_if_small
from attestry.sources.scratch import written


def places(df: DataFrame, group: str, order: list[Column], parts: int | None = None, name: str = "place") -> DataFrame:
    """df with each row's place in its group, from 1; what row_number() over the group would give, without a task for each group.

    Rows are dealt out by ranges of (group, order), so a group that holds most
    rows lies in many parts, and each part is sorted. A part counts its rows
    of each group as they pass; where a group goes on from part to part, the
    sums of the earlier counts are added. Rows that are equal in group and
    order are placed in any order, as row_number() does. Null groups are one.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc_nulls_first(group), *order]
    sorted_parts = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    own = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    names = df.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(group).dictionary_encode("encode")
            codes = keys.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            first, final = (keys.dictionary[int(codes[i])].as_py() for i in (0, -1))
            begun = seen if last is not None and last[0] == first else 0
            run = np.repeat(starts, np.diff(np.append(starts, len(codes))))
            local = np.arange(len(codes)) - run + 1
            local[run == 0] += begun
            last, seen = (final,), int(local[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64())], names=[*names, "_part", "_local"])

    # Read twice below: written, as ranges are drawn from a sample anew each time.
    dealt = written(sorted_parts.withColumn("_part", F.spark_partition_id()).mapInArrow(count, own), "places")
    counts = dealt.groupBy(F.col(group).alias("_group"), "_part").agg(F.max("_local").alias("n"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each group and part that holds it: as many as groups and parts together.
    before = counts.select("_group", F.col("_part").alias("_of"), F.sum("n").over(earlier).alias("_before")).where("_before IS NOT NULL")
    joined = dealt.join(broadcast_if_small(before), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")), "left")
    return joined.select(*names, (F.coalesce("_before", F.lit(0)) + F.col("_local")).cast("int").alias(name))
