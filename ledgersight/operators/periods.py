"""Tagging, reducing and uniting the period files of an event log."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.casts import column
from .lineage import materialise
from .skew import DEFAULT_POLICY, SkewPolicy, hot_keys, is_small, lookup_join


def tag(df: DataFrame, **literals) -> DataFrame:
    """Add constant columns; a value may be (value, spark type)."""
    typed = {name: F.lit(v[0]).cast(v[1]) if isinstance(v, tuple) else F.lit(v)
             for name, v in literals.items()}
    return df.withColumns(typed)


def union_strict(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, which must have the same columns."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_diagonal(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; a column absent from one is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def customers_of(df: DataFrame) -> DataFrame:
    return df.select("customer_id").distinct()


def keep_customers(df: DataFrame, customers: DataFrame,
                   policy: SkewPolicy = DEFAULT_POLICY, hot="find") -> DataFrame:
    """Rows whose customer is listed; the list never passes the driver."""
    return lookup_join(df, materialise(customers), "customer_id", "left_semi", policy, hot)


def keep_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose event is listed; event ids are unique, so a plain semi-join is even."""
    return df.join(ids.select("event_id").distinct(), "event_id", "left_semi")


def attach_by_event(df: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
    """Join labels or late columns on event_id, keeping one copy of shared columns."""
    extra = [c for c in other.columns if c == "event_id" or c not in df.columns]
    return df.join(other.select(*extra), "event_id", how)


def attach_labels(df: DataFrame, labels: DataFrame,
                  policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Left join of the sparse label table; it is broadcast when its row count allows.

    That saves shuffling the wide log by event before it is shuffled by customer.
    """
    small = is_small(labels, policy)
    return attach_by_event(df, F.broadcast(labels) if small else labels)


def tagged_union(frames: dict, reduce_to_history: bool = True,
                 policy: SkewPolicy = DEFAULT_POLICY, hot="find") -> DataFrame:
    """One log over all periods with a ``period`` column.

    Scored periods keep only customers that have pre-train history when
    ``reduce_to_history`` is set.
    """
    tagged = {p: tag(frames[p], period=p) for p in fv.PERIODS if p in frames}
    history = [df for p, df in tagged.items() if p in ("pretrain", "train")]
    scored = [df for p, df in tagged.items() if p in ("pretest", "test")]
    if scored and reduce_to_history and "pretrain" in frames:
        customers = customers_of(frames["pretrain"])
        scored = [keep_customers(union_diagonal(*scored), customers, policy, hot)]
    return union_diagonal(*history, *scored)


def hot_customers(frames, policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame | None:
    """Customers too large for one task over all frames, from their raw id column alone.

    Joins and filters that follow only remove rows, so the list stays a safe choice.
    """
    ids = [df.select(F.col("customer_id").cast("bigint").alias("customer_id"))
           for df in frames if df is not None]
    return hot_keys(reduce(lambda a, b: a.union(b), ids), "customer_id", policy)


def since(df: DataFrame, start, time="event_ts", days_before: int = 0) -> DataFrame:
    """Rows at or after ``start`` minus ``days_before`` days."""
    border = F.lit(start).cast("timestamp") - F.make_dt_interval(F.lit(days_before))
    return df.where(column(time) >= border)


def since_text(df: DataFrame, start: str, time: str = "event_dttm") -> DataFrame:
    """Rows at or after ``start``, compared as sortable timestamp text.

    Unlike a parsed comparison this reaches the Parquet scan when time is stored as text.
    """
    return df.where(F.col(time) >= F.lit(start))


def labelled(df: DataFrame, target: str = "target") -> DataFrame:
    return df.where(F.col(target).isNotNull())
