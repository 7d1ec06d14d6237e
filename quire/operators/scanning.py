"""How table scans are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tables of fewer bytes are dealt out again.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt to all cores if it is small by the planner's estimate.

    A small table is often one row group and so one task, however much each row
    costs. Large tables have row groups enough and pass unchanged: no shuffle.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(size) >= SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
