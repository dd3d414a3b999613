"""Average precision of many weighted sums over the same large table.

A curve is a weighted sum of columns. Rows are read once per pass and never multiplied: each task sorts its rows
by a curve's score, joins equal scores, and sends what falls in a range of scores as one compressed block, a few bytes a
row and curve. Ranges are of about equal depth, cut at scores of a sample; the sample only balances the
tasks. A range meets the totals of all higher ranges, so no curve is walked in one task.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 500_000        # rows a task sorts at a time
SAMPLED = 200               # rows per range the borders are taken from


def wide_precision(rows: DataFrame, curves, label: str = "label", range_rows: int = 1_000_000) -> DataFrame:
    """curve (its place in ``curves``), ap, n_pos, n_rows: one row per curve, none for an empty table.

    A curve is a sequence of (weight, column), summed in that order. Tied scores are one threshold, a score with a null
    column is below all others, NaN above. ``rows`` is read four times, so it should be a stored table.
    """
    columns = list(dict.fromkeys(c for curve in curves for _, c in curve))
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in columns],
                       F.coalesce(F.col(label).cast("bigint"), F.lit(0)).alias("_tp"))
    count = rows.count()
    ranges = count // range_rows + 1
    sample = rows.sample(min(1.0, SAMPLED * ranges / max(1, count)), seed=7).toArrow()
    borders = [_cuts(score(sample, curve)[0], ranges) for curve in curves]
    shared = rows.sparkSession.sparkContext.broadcast(borders)

    def count_ranges(batches):
        totals = [np.zeros((2, len(b) + 2), dtype=np.int64) for b in shared.value]
        for batch in batches:
            tp = batch["_tp"].to_numpy()
            for curve, cuts, total in zip(curves, shared.value, totals):
                x, valid = score(batch, curve)
                at = np.zeros(len(tp), dtype=np.int64)          # 0: a null column
                at[valid] = 1 + np.searchsorted(cuts, x, side="right")
                total[0] += np.bincount(at, minlength=total.shape[1])
                np.add.at(total[1], at[tp != 0], tp[tp != 0])
        for i, (n, tp) in enumerate(totals):
            some = np.flatnonzero(n)
            yield pa.record_batch({"curve": pa.array(np.full(len(some), i, np.int32)), "range": pa.array(some - 1),
                                   "n": pa.array(n[some]), "tp": pa.array(tp[some])})

    def cut_blocks(batches):
        for block in _blocks(batches):
            tp = block["_tp"].to_numpy()
            for i, (curve, cuts) in enumerate(zip(curves, shared.value)):
                x, valid = score(block, curve)
                steps = _joined(x, np.ones(len(x), np.int64), tp[valid])
                starts = np.concatenate([[0], np.searchsorted(steps[0], cuts, side="left"), [len(steps[0])]])
                some = np.flatnonzero(np.diff(starts))
                yield pa.record_batch({
                    "curve": pa.array(np.full(len(some), i, np.int32)), "range": pa.array(some), "size": pa.array(np.diff(starts)[some]),
                    "data": pa.array([_pack(*(s[starts[r]:starts[r + 1]] for s in steps)) for r in some], pa.binary())})

    key = "curve int, range bigint"
    totals = rows.mapInArrow(count_ranges, f"{key}, n bigint, tp bigint").groupBy("curve", "range").agg(
        F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    higher = W.partitionBy("curve").orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumns({f"{c}_above": F.coalesce(F.sum(c).over(higher), F.lit(0)) for c in ("n", "tp")})
    blocks = rows.mapInArrow(cut_blocks, f"{key}, size bigint, data binary")
    parts = blocks.unionByName(totals, allowMissingColumns=True).groupBy("curve", "range")
    areas = parts.applyInArrow(_area, "curve int, area double, n bigint, tp bigint")
    found = areas.groupBy("curve").agg(F.sum("area").alias("area"), F.sum("tp").alias("n_pos"), F.sum("n").alias("n_rows"))
    return found.select("curve", F.try_divide("area", F.col("n_pos").cast("double")).alias("ap"), "n_pos", "n_rows")


def score(batch, curve) -> tuple[np.ndarray, np.ndarray]:
    """(scores of the rows without a null column, which rows those are)."""
    valid, total = np.ones(batch.num_rows, bool), None
    for weight, name in curve:
        column = batch[name]
        valid &= np.asarray(column.is_valid())
        values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
        term = weight * values.astype(np.float64, copy=False)
        total = term if total is None else total + term
    return total[valid], valid


def _cuts(x: np.ndarray, ranges: int) -> np.ndarray:
    """Up to ranges - 1 scores between ranges of about equal depth."""
    x = np.sort(x)
    return np.unique(x[np.arange(1, ranges) * len(x) // ranges]) if len(x) else x


def _blocks(batches):
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _joined(x: np.ndarray, n: np.ndarray, tp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct scores in rising order, their rows, their true positives)."""
    order = np.argsort(x)
    x = x[order]
    starts = np.flatnonzero(np.concatenate([[len(x) > 0], (x[1:] != x[:-1]) & ~np.isnan(x[:-1])]))
    return (x[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v for v in (n, tp)))


def _planes(numbers: np.ndarray) -> bytes:
    """All first bytes, all second ones and so on: bytes that hardly change compress."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _pack(x: np.ndarray, n: np.ndarray, tp: np.ndarray) -> bytes:
    bits = (x + 0.0).view(np.int64)
    return pa.compress(_planes(np.diff(bits, prepend=0)) + _planes(n.astype(np.int32)) + _planes(tp), codec="lz4_raw", asbytes=True)


def _unpack(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, 20 * size, codec="lz4_raw", asbytes=True), np.uint8)

    def numbers(start, width, kind):
        return np.ascontiguousarray(raw[start * size:(start + width) * size].reshape(width, size).T).view(kind)[:, 0]

    return np.cumsum(numbers(0, 8, np.int64)).view(np.float64), numbers(8, 4, np.int32).astype(np.int64), numbers(12, 8, np.int64)


def _area(key, table):
    """The part of the area that the steps of one range add, with the range's totals."""
    blocks, total = [], None
    for size, data, *counts in zip(*(table[c].to_pylist() for c in ("size", "data", "n", "tp", "n_above", "tp_above"))):
        if data is None:
            total = counts
        else:
            blocks.append(_unpack(data, size))
    n_all, tp_all, n_above, tp_above = total
    if blocks:
        _, n, tp = _joined(*(np.concatenate(part) for part in zip(*blocks)))
    else:                       # scores with a null column: one step below all others
        n, tp = np.array([n_all]), np.array([tp_all])
    cn, ctp = (above + np.cumsum(v[::-1])[::-1] for above, v in ((n_above, n), (tp_above, tp)))
    return pa.table({"curve": pa.array([key[0].as_py()], pa.int32()), "area": pa.array([float((tp * ctp.astype(float) / cn).sum())]),
                     "n": pa.array([n_all], pa.int64()), "tp": pa.array([tp_all], pa.int64())})
