"""Left-closed rolling aggregates, gaps and session totals per customer.

A rolling frame is [t - period, t): rows at the current timestamp, the current row
included, are outside it. Each rolling value is the difference of two running values,
"everything before t" minus "everything before t - period". Running frames only ever
grow, so the work is linear in the rows whatever the period; a sliding frame would be
re-aggregated for every row.

Customers with more rows than one task should hold take a second route: rows are
combined per timestamp, every period adds a row that cancels the amount when it leaves
the frame, and running sums are taken in two levels over time slices. Both routes
return the same values.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.casts import AMOUNT_SCALE, exact_amount, exact_parts, joined_parts
from ..functions.calendar import DAY_US, HOUR_US, seconds_between
from .lineage import materialise
from .skew import (DEFAULT_POLICY, SkewPolicy, hot_keys, lookup_join, null_safe_join,
                   split_hot)
from .timeline import neighbour_time, slice_width, sums_before

CUSTOMER = "customer_id"
TIME = "event_us"


@dataclass(frozen=True)
class Rolling:
    """One rolling feature: what is sum, count, mean or distinct."""

    name: str
    what: str
    period_us: int
    value: str = "amt"
    extra_keys: tuple = ()

    @property
    def keys(self):
        return (CUSTOMER, *self.extra_keys)


def velocity_specs(amount="amt", mcc="mcc_code"):
    """The rolling features of the velocity block."""
    return (
        Rolling("amt_1h", "sum", HOUR_US, amount),
        Rolling("cnt_1h", "count", HOUR_US),
        Rolling("amt_24h", "sum", DAY_US, amount),
        Rolling("cnt_24h", "count", DAY_US),
        Rolling("avg_amt_7d", "mean", 7 * DAY_US, amount),
        Rolling("amt_sum_7d", "sum", 7 * DAY_US, amount),
        Rolling("amt_30d", "sum", 30 * DAY_US, amount),
        Rolling("cnt_30d", "count", 30 * DAY_US),
        Rolling("mcc_count_24h", "count", DAY_US, extra_keys=(mcc,)),
        Rolling("unique_mcc_7d", "distinct", 7 * DAY_US, mcc),
    )


@dataclass(frozen=True)
class Gap:
    """Whole seconds since the previous row of the same keys."""

    name: str
    extra_keys: tuple = ()
    first: int = fv.FIRST_GAP_SECONDS

    @property
    def keys(self):
        return (CUSTOMER, *self.extra_keys)


@dataclass(frozen=True)
class Totals:
    """Sum and row count over the whole (customer, session), later rows included.

    With ``causal`` only rows up to the current timestamp count.
    """

    sum_name: str = "session_amt_sum"
    count_name: str = "session_cnt"
    session: str = "session_id"
    value: str = "amt"
    causal: bool = False

    @property
    def keys(self):
        return (CUSTOMER, self.session)


def timeline_features(df: DataFrame, rolling=(), gaps=(), totals=(), scale: int = AMOUNT_SCALE,
                      policy: SkewPolicy = DEFAULT_POLICY, hot="find") -> DataFrame:
    """Add rolling, gap and session features to an event log.

    ``df`` needs customer_id, event_us (microseconds), event_id and the value columns.
    Amounts are summed exactly with ``scale`` digits (see ``exact_amount``).
    ``hot`` is the table of hot customers when already known, None for "no hot customers".
    """
    if isinstance(hot, str):
        hot = hot_keys(df, CUSTOMER, policy)
    if hot is None:
        return _by_customer(df, rolling, gaps, totals, scale)
    ordinary, heavy = split_hot(df, hot, CUSTOMER)
    return _by_customer(ordinary, rolling, gaps, totals, scale).unionByName(
        _by_slice(heavy, rolling, gaps, totals, scale, policy))


# --- ordinary customers: windows after one shuffle on the customer --------------------

def _by_customer(df, rolling, gaps, totals, scale):
    wanted = df.columns + [r.name for r in rolling] + [g.name for g in gaps]
    wanted += [n for t in totals for n in (t.sum_name, t.count_name)]
    # every window below is keyed by the customer or finer, so this one shuffle serves all
    df = df.repartition(CUSTOMER)
    amounts = {s.value for s in rolling if s.what in ("sum", "mean")} | {t.value for t in totals}
    df = df.withColumns({f"_{part}_{c}": value for c in sorted(amounts)
                         for part, value in zip(("whole", "rest"), exact_parts(c, scale))})

    # finer keys first; per key the row-ordered gaps come before the time-ordered frames,
    # so one sort serves both
    distinct = [r for r in rolling if r.what == "distinct"]
    key_sets = {g.keys for g in gaps} | {r.keys for r in rolling if r.what != "distinct"}
    for keys in sorted(key_sets, key=lambda k: (-len(k), k)):
        if len(keys) == 1:
            for spec in distinct:
                df = _distinct_by_customer(df, spec)
            distinct = []
        df = _gaps_by_keys(df, keys, [g for g in gaps if g.keys == keys])
        df = _rolling_by_keys(
            df, keys, [r for r in rolling if r.keys == keys and r.what != "distinct"], scale)
    for spec in distinct:
        df = _distinct_by_customer(df, spec)

    for t in totals:
        w = W.partitionBy(*t.keys)
        if t.causal:
            w = w.orderBy(TIME).rangeBetween(W.unboundedPreceding, 0)
        df = df.withColumns({
            "_whole": F.coalesce(F.sum(f"_whole_{t.value}").over(w), F.lit(0)),
            "_rest": F.coalesce(F.sum(f"_rest_{t.value}").over(w), F.lit(0)),
            t.count_name: F.count(F.lit(1)).over(w),
        })
        df = df.withColumn(t.sum_name, joined_parts("_whole", "_rest", scale))
    return df.select(*wanted)


def _gaps_by_keys(df, keys, gaps):
    order = W.partitionBy(*keys).orderBy(TIME, "event_id")
    if not gaps:
        return df
    df = df.withColumn("_last", F.lag(TIME).over(order))
    return df.withColumns({
        g.name: F.coalesce(seconds_between(TIME, "_last"), F.lit(g.first)) for g in gaps
    }).drop("_last")


def _rolling_by_keys(df, keys, specs, scale):
    """Running values up to now and up to each frame start, each computed once."""
    if not specs:
        return df

    def running(source, end):
        frame = (W.partitionBy(*keys).orderBy(TIME)
                 .rangeBetween(W.unboundedPreceding, end))
        what, _, c = source.partition(":")
        if what == "rows":
            return F.coalesce(F.count(F.lit(1)).over(frame), F.lit(0))
        value = {"whole": F.sum(f"_whole_{c}"), "rest": F.sum(f"_rest_{c}"),
                 "present": F.count(f"_whole_{c}")}[what]
        return F.coalesce(value.over(frame), F.lit(0))

    needs = {"count": ("rows:",), "sum": ("whole:", "rest:"), "mean": ("whole:", "rest:", "present:")}
    sources = {}
    for spec in specs:
        suffix = "" if spec.what == "count" else spec.value
        sources[spec.name] = [need + suffix for need in needs[spec.what]]
    helpers = {}
    for spec in specs:
        for source in sources[spec.name]:
            helpers[f"_now_{source}"] = running(source, -1)
            helpers[f"_ago_{source}_{spec.period_us}"] = running(source, -spec.period_us - 1)
    df = df.withColumns(helpers)

    features = {}
    for spec in specs:
        inside = [F.col(f"`_now_{s}`") - F.col(f"`_ago_{s}_{spec.period_us}`")
                  for s in sources[spec.name]]
        if spec.what == "count":
            features[spec.name] = inside[0]
        elif spec.what == "sum":
            features[spec.name] = joined_parts(*inside, scale)
        else:
            features[spec.name] = F.try_divide(
                joined_parts(*inside[:2], scale), inside[2].cast("double"))
    return df.withColumns(features).drop(*helpers)


def _distinct_by_customer(df, spec):
    """Distinct values in the frame, nulls counting as one value.

    A row stands for its value from its own time until the value shows up again or
    the row leaves the frame. Counting rows whose stand began before t and not ended
    gives the distinct count as a running sum. Only the row that begins a stand carries
    the other columns.
    """
    same_value = W.partitionBy(*spec.keys, spec.value).orderBy(TIME, "event_id")
    until = F.least(F.col(TIME) + spec.period_us, F.lead(TIME).over(same_value))
    others = [c for c in df.columns if c not in spec.keys]
    marks = F.array(
        F.struct(F.col(TIME).alias("_at"), F.lit(1).alias("_step"), F.struct(*others).alias("_row")),
        F.struct(F.col("_until").alias("_at"), F.lit(-1).alias("_step"), F.lit(None).alias("_row")),
    )
    earlier = (W.partitionBy(*spec.keys).orderBy("_at")
               .rangeBetween(W.unboundedPreceding, -1))
    return (
        df.withColumn("_until", until)
        .select(*spec.keys, F.inline(marks))
        .withColumn(spec.name, F.coalesce(F.sum("_step").over(earlier), F.lit(0)))
        .where(F.col("_step") == 1).select(*spec.keys, "_row.*", spec.name)
    )


# --- hot customers: per-timestamp sums over time slices -------------------------------

def _by_slice(df, rolling, gaps, totals, scale, policy):
    wanted = df.columns + [r.name for r in rolling] + [g.name for g in gaps]
    wanted += [n for t in totals for n in (t.sum_name, t.count_name)]
    width = slice_width(df, CUSTOMER, TIME, policy)
    running = [t for t in totals if t.causal]
    source = df
    for keys in sorted({s.keys for s in (*rolling, *gaps, *running)}):
        # one table per key set, so the events are joined once per key set
        plain = [r for r in rolling if r.keys == keys and r.what != "distinct"]
        parts = [_rolling_ticks(source, keys, plain, scale, width)] if plain else []
        parts += [_distinct_ticks(source, r, width) for r in rolling
                  if r.keys == keys and r.what == "distinct"]
        parts += [_total_ticks(source, t, scale, width) for t in running if t.keys == keys]
        mine = [g for g in gaps if g.keys == keys]
        parts += [_gap_ticks(source, keys, width)] if mine else []
        ticks = reduce(lambda a, b: null_safe_join(a, b, [*keys, TIME], "inner"), parts)
        df = lookup_join(df, materialise(ticks), [*keys, TIME], policy=policy)
        for gap in mine:
            df = df.withColumn(gap.name, F.when(
                F.col("event_id") == F.col("_first_id"),
                F.coalesce(seconds_between(TIME, "_previous"), F.lit(gap.first))
            ).otherwise(F.lit(0)))
        df = df.drop("_first_id", "_previous")
    for t in totals:
        if not t.causal:
            per_session = source.groupBy(*t.keys).agg(
                F.coalesce(F.sum(exact_amount(t.value, scale)), F.lit(0)).cast("double").alias(t.sum_name),
                F.count(F.lit(1)).alias(t.count_name))
            df = lookup_join(df, materialise(per_session), t.keys, policy=policy)
    return df.select(*wanted)


def _rolling_ticks(df, keys, specs, scale, width):
    values = sorted({s.value for s in specs if s.what != "count"})
    per_tick = df.groupBy(*keys, TIME).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(exact_amount(v, scale)).alias(f"_u_{v}") for v in values],
        *[F.count(v).alias(f"_c_{v}") for v in values],
    )
    periods = sorted({s.period_us for s in specs})
    marks = F.array(
        F.struct(F.col(TIME).alias("at"), F.lit(-1).alias("leaves")),
        *[F.struct((F.col(TIME) + p).alias("at"), F.lit(i).alias("leaves"))
          for i, p in enumerate(periods)],
    )
    measures = {}
    for spec in specs:
        i = periods.index(spec.period_us)
        sources = {"count": ["_n"], "sum": [f"_u_{spec.value}"],
                   "mean": [f"_u_{spec.value}", f"_c_{spec.value}"]}[spec.what]
        for source in sources:
            measures[f"{source}_{i}"] = F.sum(
                F.when(F.col("_mark.leaves") == -1, F.col(source))
                .when(F.col("_mark.leaves") == i, -F.col(source)).otherwise(0))
    ticks = (
        per_tick.withColumn("_mark", F.explode(marks))
        .groupBy(*keys, F.col("_mark.at").alias(TIME))
        .agg(*[F.coalesce(m, F.lit(0)).alias(name) for name, m in measures.items()],
             F.max(F.col("_mark.leaves") == -1).alias("_event"))
    )
    before = sums_before(ticks, keys, TIME, list(measures), width).where("_event")
    features = []
    for spec in specs:
        i = periods.index(spec.period_us)
        if spec.what == "count":
            value = F.col(f"_n_{i}")
        elif spec.what == "sum":
            value = F.col(f"_u_{spec.value}_{i}").cast("double")
        else:
            value = F.try_divide(F.col(f"_u_{spec.value}_{i}").cast("double"),
                                 F.col(f"_c_{spec.value}_{i}").cast("double"))
        features.append(value.alias(spec.name))
    return before.select(*keys, TIME, *features)


def _distinct_ticks(df, spec, width):
    seen = df.select(*spec.keys, spec.value, TIME).distinct()
    seen = neighbour_time(seen, [*spec.keys, spec.value], TIME, width, "_next", following=True)
    until = F.least(F.col(TIME) + spec.period_us, F.col("_next"))
    marks = F.array(
        F.struct(F.col(TIME).alias("at"), F.lit(1).alias("step")),
        F.struct(until.alias("at"), F.lit(-1).alias("step")),
    )
    ticks = (
        seen.select(*spec.keys, F.explode(marks).alias("_mark"))
        .groupBy(*spec.keys, F.col("_mark.at").alias(TIME))
        .agg(F.sum("_mark.step").alias(spec.name),
             F.max(F.col("_mark.step") == 1).alias("_event"))
    )
    return (sums_before(ticks, spec.keys, TIME, [spec.name], width)
            .where("_event").drop("_event"))


def _gap_ticks(df, keys, width):
    ticks = df.groupBy(*keys, TIME).agg(F.min("event_id").alias("_first_id"))
    return neighbour_time(ticks, keys, TIME, width, "_previous", following=False)


def _total_ticks(df, t, scale, width):
    ticks = df.groupBy(*t.keys, TIME).agg(
        F.sum(exact_amount(t.value, scale)).alias(t.sum_name),
        F.count(F.lit(1)).alias(t.count_name))
    ticks = sums_before(ticks, t.keys, TIME, [t.sum_name, t.count_name], width, inclusive=True)
    return ticks.withColumn(t.sum_name, F.col(t.sum_name).cast("double"))
