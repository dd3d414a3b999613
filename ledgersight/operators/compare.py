"""How far score files agree: disagreement per event and correlations."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.rowwise import row_mean, row_std


def disagreement(merged: DataFrame) -> DataFrame:
    """event_id, mean_pred, std_pred and the pred_* columns."""
    scores = [c for c in merged.columns if c.startswith("pred_")]
    return merged.select(
        "event_id", row_mean(scores).alias("mean_pred"), row_std(scores).alias("std_pred"),
        *scores)


def by_disagreement(table: DataFrame) -> DataFrame:
    """Most disputed first; a null deviation sorts before all others."""
    return table.orderBy(F.desc_nulls_first("std_pred"), "event_id")


def most_disputed(table: DataFrame, n: int = fv.TOP_DISPUTED) -> DataFrame:
    return by_disagreement(table).limit(n)


FAN = 256       # first-level groups of partial states


def correlation_matrix(df: DataFrame, columns) -> DataFrame:
    """Pearson correlation of every pair, as rows (col_a, col_b, corr).

    Each pair uses the rows where both values are present. A partition gives one state: for all pairs at once the counts,
    sums, squares and products of values centred on their column's mean, four products of a batch's matrices. States
    are added in two levels, so neither rows nor the shuffle grow with the number of pairs. A pair with fewer than two rows
    is null, one with a constant side NaN; a NaN or infinite value makes the pairs of its column NaN. An empty table gives no rows.
    """
    columns = list(columns)
    k = len(columns)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    facts = rows.agg(*[f(f"c{i}") for i in range(k) for f in (F.min, F.max, F.avg)]).first()
    # a constant column is centred on its value, whatever its mean is rounded to
    centre = np.array([0.0 if low is None else low if low == high else mean
                       for low, high, mean in (facts[3 * i:3 * i + 3] for i in range(k))])

    def state(batches):
        total, seen = np.zeros((4, k, k)), 0
        for batch in batches:
            seen += batch.num_rows
            mask = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.where(mask > 0, x - centre, 0.0)
            total += [mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x]
        if seen:
            yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId() % FAN], pa.int32()),
                                   "state": pa.array([total.ravel()], pa.list_(pa.float64()))})

    def finish(batches):
        for batch in batches:
            for row in batch["state"]:
                n, s, q, p = row.values.to_numpy().reshape(4, k, k)
                with np.errstate(all="ignore"):
                    mean, spread = s / n, q - s * s / n         # of a, where b is present too
                    spread[spread <= 1e-13 * n * mean * mean] = 0.0
                    corr = (p - s * s.T / n) / np.sqrt(spread * spread.T)
                    corr = np.where(np.isfinite(corr), np.clip(corr, -1, 1), np.nan)
                yield pa.record_batch({
                    "col_a": pa.array(np.repeat(columns, k), pa.string()), "col_b": pa.array(list(columns) * k, pa.string()),
                    "corr": pa.array(corr.ravel(), mask=(n < 2).ravel())})

    summed = lambda states, key: states.groupBy(key).agg(
        vector_to_array(Summarizer.sum(array_to_vector("state"))).alias("state"))
    some = summed(rows.mapInArrow(state, "part int, state array<double>"), F.col("part"))
    return summed(some, F.lit(0).alias("all")).select("state").mapInArrow(finish, "col_a string, col_b string, corr double")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("corr"))
