"""Heavy hitters over all rows by mergeable summaries of bounded size."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: How many summaries meet in one task.
FAN_IN = 32


def shrink(counts: dict, size: int) -> dict:
    """Keep ``size`` keys at most: take the next largest count off all (Misra and Gries)."""
    if len(counts) <= size:
        return counts
    floor = sorted(counts.values(), reverse=True)[size]
    return {k: v - floor for k, v in counts.items() if v > floor}


def heavy_hitters(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterable[dict]], kind: str, size: int) -> list[tuple]:
    """The keys that may hold more than 1/size of all occurrences, with lower bounds of their counts.

    ``keys_of`` turns a batch into dictionaries of counts. A task keeps one summary of at most
    ``size`` keys, and summaries merge in a tree, so no task and not the driver ever gets more
    than FAN_IN * size keys, however large the input.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for counts in keys_of(batch):
                total.update(counts)
                if len(total) > 8 * size:
                    total = Counter(shrink(total, size))
        total = shrink(total, size)
        at = TaskContext.get().partitionId()
        keys = pa.array(list(total), pa.int64() if kind == "long" else pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([list(total.values())], pa.list_(pa.int64()))], ["slot", "keys", "counts"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        for keys, counts in zip(pdf["keys"], pdf["counts"], strict=True):
            for k, c in zip(keys, counts, strict=True):
                total[k] += int(c)
        total = shrink(total, size)
        return pd.DataFrame({"slot": [int(pdf["slot"].iloc[0]) // FAN_IN], "keys": [list(total)], "counts": [list(total.values())]})

    schema = f"slot long, keys array<{kind}>, counts array<long>"
    left = df.rdd.getNumPartitions()
    summaries = df.mapInArrow(lean(gather), schema)
    while True:
        summaries = summaries.groupBy(F.expr(f"slot div {FAN_IN}").alias("g")).applyInPandas(merge, schema)
        left = -(-left // FAN_IN)
        if left <= 1:
            break
    return [(k, c) for row in summaries.collect() for k, c in zip(row["keys"], row["counts"], strict=True)]
