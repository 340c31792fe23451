"""Bootstrap intervals from one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_interval(rows: DataFrame, key: str, value: str, resamples: int, level: float, seed: int) -> DataFrame:
    """``key, n, mean, low, high``: percentile interval of the mean over Poisson resamples.

    Each partition draws Poisson(1) weights for its rows, seeded by its number, and emits one sum
    and weight per key and resample: what is shuffled does not grow with the rows.  Null keys and
    values are left out."""
    kind = rows.schema[key].dataType.simpleString()
    part = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("x"), F.spark_partition_id().alias("p")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        rng = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rng = rng or np.random.default_rng([seed, batch.column("p")[0].as_py()])
            keys, x = np.array(batch.column("k").to_pylist(), dtype=object), batch.column("x").to_numpy()
            for k in dict.fromkeys(keys):
                own = x[keys == k]
                acc = sums.setdefault(k, [0, 0.0, np.zeros(resamples), np.zeros(resamples)])
                acc[0] += len(own)
                acc[1] += own.sum()
                for s in range(0, len(own), 1024):
                    w = rng.poisson(1.0, (resamples, len(own[s : s + 1024])))
                    acc[2] += w @ own[s : s + 1024]
                    acc[3] += w.sum(axis=1)
        for k, (n, total, s, w) in sums.items():
            m = resamples
            yield pa.RecordBatch.from_pydict({"k": [k] * m, "b": list(range(m)), "n": [n] * m, "t": [total] * m, "s": s, "w": w})

    got = part.mapInArrow(run, f"k {kind}, b long, n long, t double, s double, w double")
    per = got.groupBy("k", "b").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    out = per.groupBy("k").agg(F.max("n").alias("n"), F.max(F.col("t") / F.col("n")).alias("mean"), F.percentile("m", F.lit([tail, 1 - tail])).alias("q"))
    return out.select(F.col("k").alias(key), "n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
