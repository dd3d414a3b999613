"""Filling nulls with column means and exact medians."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv


def fill_means(df: DataFrame, columns, source: DataFrame | None = None) -> DataFrame:
    """Nulls become the column mean over ``source`` (by default ``df`` itself)."""
    columns = list(columns)
    if not columns:
        return df
    means = (source or df).agg(*[F.avg(c).alias(c) for c in columns]).first()
    return _fill(df, {c: means[c] for c in columns})


def fill_medians(df: DataFrame, columns, source: DataFrame | None = None) -> DataFrame:
    """Nulls become the exact median over ``source``, the training rows."""
    columns = list(columns)
    return _fill(df, exact_medians(source or df, columns)) if columns else df


def fill_categories(df: DataFrame, columns, fill: int = fv.NULL_INTEGER) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("bigint"), F.lit(fill).cast("bigint")) for c in columns})


def _fill(df, values):
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items()
        if v is not None})


def exact_medians(df: DataFrame, columns, exact_rows: int = 100_000,
                  accuracy: int = 10_000) -> dict:
    """Column -> exact median of its non-null values (None for an empty column).

    Spark's exact median keeps every distinct value in one task. Here each pass narrows
    a bracket around the middle with an approximate quantile sketch and counts what lies
    below it; once a bracket is short the middle rows are picked from it. A bracket
    always contains the middle, so the result is exact. All columns share the passes.
    """
    columns = list(columns)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    first = values.agg(*[x for c in columns for x in (
        F.count(c).alias(f"n_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    state = {}
    for c in columns:
        n = first[f"n_{c}"]
        if n:
            state[c] = {"rank": (n - 1) // 2, "pair": n % 2 == 0, "below": 0, "inside": n,
                        "lo": first[f"lo_{c}"], "hi": first[f"hi_{c}"]}
    while True:
        wide = [c for c, s in state.items() if s["inside"] > exact_rows and s["lo"] < s["hi"]]
        if not wide:
            break
        if not _narrow(values, state, wide, accuracy):
            _peel(values, state, wide)
    return {c: _pick(values, c, state.get(c)) for c in columns}


def _inside(c, s):
    return F.col(c).between(F.lit(s["lo"]), F.lit(s["hi"]))


def _narrow(values, state, columns, accuracy) -> bool:
    """Shrink the brackets of ``columns``; False when none got shorter."""
    brackets = []
    for c in columns:
        s = state[c]
        share = (s["rank"] - s["below"]) / s["inside"]
        around = [max(0.0, share - 3.0 / accuracy), min(1.0, share + 3.0 / accuracy)]
        brackets.append(F.percentile_approx(
            F.when(_inside(c, s), F.col(c)), around, accuracy).alias(c))
    found = values.agg(*brackets).first()
    counts = values.agg(*[x for c in columns for x in (
        F.count_if(F.col(c) < found[c][0]).alias(f"below_{c}"),
        F.count_if(F.col(c).between(found[c][0], found[c][1])).alias(f"inside_{c}"))]).first()
    moved = False
    for c in columns:
        s = state[c]
        below, inside = counts[f"below_{c}"], counts[f"inside_{c}"]
        last = s["rank"] + (1 if s["pair"] else 0)
        if below <= s["rank"] and last < below + inside and inside < s["inside"]:
            s.update(lo=found[c][0], hi=found[c][1], below=below, inside=inside)
            moved = True
    return moved


def _peel(values, state, columns) -> None:
    """Settle the lowest value of each bracket: the middle lies among its ties, or above them.

    This is for values so often repeated that no sketch cuts them; only counts reach the driver.
    """
    found = values.agg(*[x for c in columns for x in (
        F.count_if(F.col(c) == state[c]["lo"]).alias(f"n_{c}"),
        F.min(F.when(_inside(c, state[c]) & (F.col(c) > state[c]["lo"]), F.col(c))).alias(f"next_{c}"))]).first()
    for c in columns:
        s, above = state[c], found[f"next_{c}"]
        end = s["below"] + found[f"n_{c}"]
        if s["rank"] + (1 if s["pair"] else 0) < end:
            s["hi"] = s["lo"]
        elif s["rank"] < end:       # the middle pair is the last tie and the next value
            s["lo"] = s["hi"] = (s["lo"] + above) / 2
        else:
            s.update(lo=above, below=end, inside=s["inside"] - found[f"n_{c}"])


def _pick(values, c, s):
    if s is None:
        return None
    if s["lo"] == s["hi"]:
        return s["lo"]
    skip = s["rank"] - s["below"]
    middle = (values.where(_inside(c, s)).select(c).orderBy(c)
              .offset(skip).limit(2 if s["pair"] else 1))
    return reduce(lambda a, b: (a + b) / 2, [r[0] for r in middle.collect()])
