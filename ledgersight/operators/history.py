"""Running history of a customer: counts, sums and times of earlier rows.

Rows are ordered by (event_us, event_id); every value looks only at rows before the
current one. Ordinary customers share one shuffle on the customer. A hot customer is
spread over time slices, each opened by rows that carry the totals so far (see
``timeline``), and the same expressions run per slice.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.calendar import seconds_between
from ..functions.casts import AMOUNT_SCALE, exact_amount, exact_square
from .lineage import materialise
from .skew import DEFAULT_POLICY, SkewPolicy, hot_keys, split_hot, spread
from .timeline import slice_rows

CUSTOMER = "customer_id"
TIME = "event_us"


@dataclass(frozen=True)
class HistoryColumns:
    """Which input column plays which part."""

    amt: str = "amt"
    type: str = "event_type_nm"
    desc: str = "event_desc"
    mcc: str = "mcc_code_i"
    subtype: str = "channel_indicator_sub_type"
    session: str = "session_id"
    date: str = "event_date"

    def groups(self):
        """Group name -> key beside the customer (None for the customer itself)."""
        return {"customer": None, "type": self.type, "desc": self.desc, "mcc": self.mcc,
                "subtype": self.subtype, "session": self.session, "date": self.date}

    def inputs(self):
        """Every column the history block reads."""
        return [CUSTOMER, TIME, "event_id", self.amt, *[c for c in self.groups().values() if c]]


def history_features(df: DataFrame, columns: HistoryColumns = HistoryColumns(),
                     first_gap: int = fv.FIRST_GAP_FLAG,
                     policy: SkewPolicy = DEFAULT_POLICY, hot="find",
                     keep_running: bool = False, scale: int = AMOUNT_SCALE) -> DataFrame:
    """Add the history block. ``keep_running`` also keeps the running columns it is made of.

    Amounts are summed exactly with ``scale`` digits (see ``exact_amount``). Rows are counted, so that a task's share
    does not grow with the log.
    """
    if isinstance(hot, str):
        hot = hot_keys(df, CUSTOMER, policy)
    rows = df.count()
    if hot is None:
        out = _windows(spread(df, rows, CUSTOMER), columns, [], scale)
    else:
        ordinary, heavy = split_hot(df, hot, CUSTOMER)
        heavy = materialise(slice_rows(heavy, CUSTOMER, TIME, "event_id", policy))
        sliced = _windows(_with_openings(heavy, columns, scale), columns, ["_cell"], scale)
        out = _windows(spread(ordinary, rows, CUSTOMER), columns, [], scale).unionByName(
            sliced.where(F.col("_opens").isNull()).drop("_opens", "_cell",
                                                        *_carried(columns)))
    return _derive(out, columns, first_gap, df.columns, keep_running, scale)


def _carried(columns):
    return [f"_n_{g}" for g in columns.groups()] + ["_sum", "_sq", "_prev"]


def _with_openings(df, columns, scale):
    """Add, per slice and key group, a row with the totals of all earlier slices."""
    parts = df.withColumn("_opens", F.lit(None).cast("string"))
    rows = df.count()
    last = F.max(F.struct(TIME, "event_id", columns.amt))
    for group, extra in columns.groups().items():
        keys = [CUSTOMER] + ([extra] if extra else [])
        per_cell = df.groupBy(*keys, "_cell").agg(
            F.count(F.lit(1)).alias("n"), F.sum(exact_amount(columns.amt, scale)).alias("s"),
            F.sum(exact_square(columns.amt, scale)).alias("q"), last.alias("last"))
        per_cell = spread(per_cell, rows, *keys)
        earlier = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
        opening = per_cell.select(
            *keys, "_cell", F.lit(group).alias("_opens"),
            F.sum("n").over(earlier).alias(f"_n_{group}"),
            *([F.sum("s").over(earlier).alias("_sum"), F.sum("q").over(earlier).alias("_sq")]
              if group == "customer" else []),
            F.struct(
                F.lag("last").over(W.partitionBy(*keys).orderBy("_cell"))[TIME].alias("at"),
                F.lag("last").over(W.partitionBy(*keys).orderBy("_cell"))[columns.amt]
                .alias("amt")).alias("_prev"),
        ).where(F.col(f"_n_{group}").isNotNull())
        parts = parts.unionByName(opening, allowMissingColumns=True)
    # a slice has about as many opening rows as rows, or more
    return spread(parts, 2 * rows, CUSTOMER, "_cell")


def _windows(df, columns, cell, scale):
    """Counts, sums and previous rows over everything before the current row."""
    sliced = bool(cell)
    amt = F.col(columns.amt)

    def ordered(extra):
        keys = [CUSTOMER, *cell] + ([extra] if extra else [])
        order = [F.col("_opens").asc_nulls_last()] if sliced else []
        return W.partitionBy(*keys).orderBy(*order, F.col(TIME), F.col("event_id"))

    def before(extra):
        return ordered(extra).rowsBetween(W.unboundedPreceding, -1)

    def total(plain: Column, carried: str, w) -> Column:
        value = F.when(F.col("_opens").isNull(), plain).otherwise(F.col(carried)) if sliced else plain
        return F.sum(value).over(w)

    def count(group, extra) -> Column:
        if not sliced:
            return F.row_number().over(ordered(extra)).cast("bigint") - 1
        return F.coalesce(total(F.lit(1), f"_n_{group}", before(extra)), F.lit(0))

    def previous(group, extra) -> Column:
        if not sliced:
            w = ordered(extra)
            return F.struct(F.lag(TIME).over(w).alias("at"), F.lag(amt).over(w).alias("amt"))
        row = F.struct(F.col(TIME).alias("at"), amt.alias("amt"))
        seen = (F.when(F.col("_opens").isNull(), row)
                .when(F.col("_opens") == group, F.col("_prev")))
        return F.last(seen, ignorenulls=True).over(before(extra))

    w = before(None)
    return df.withColumns({
        **{f"_before_{g}": count(g, extra) for g, extra in columns.groups().items()},
        # decimals make the sums exact, so they do not depend on how rows were grouped
        "_before_sum": F.coalesce(total(exact_amount(columns.amt, scale), "_sum", w), F.lit(0)).cast("decimal(38,6)"),
        "_before_sq": F.coalesce(total(exact_square(columns.amt, scale), "_sq", w), F.lit(0)).cast("decimal(38,12)"),
        "_last_customer": previous("customer", None),
        "_last_type": previous("type", columns.type),
        "_last_desc": previous("desc", columns.desc),
    })


def _derive(df, columns, first_gap, base, keep_running, scale):
    amt = F.col(columns.amt)
    n = F.col("_before_customer")
    total, squares = F.col("_before_sum"), F.col("_before_sq")
    mean = total.cast("double") / n
    # n times the squares less the squared total loses nothing to cancellation; totals too long for it go through doubles
    short = total.try_cast("decimal(18,6)")
    scaled = F.try_multiply(squares.try_cast("decimal(26,12)"), n.try_cast("decimal(11,0)")).try_cast("decimal(37,12)")
    exact = F.try_subtract(scaled, short * short)
    variance = F.coalesce(exact.cast("double") / n / n, squares.cast("double") / n - mean * mean)
    spread = F.sqrt(F.greatest(variance, F.lit(0.0)))

    def since(last):
        return F.coalesce(seconds_between(TIME, f"{last}.at"), F.lit(first_gap))

    features = {
        "cust_prev_events": n,
        # no amount on the row, no comparison with earlier amounts
        "cust_prev_amt_mean": F.when(n > 0, F.when(amt.isNotNull(), mean)).otherwise(F.lit(0.0)),
        "cust_prev_amt_std": F.when(n > 1, F.when(amt.isNotNull(), spread)).otherwise(F.lit(0.0)),
        "sec_since_prev_event": since("_last_customer"),
        "amt_delta_prev": amt - F.coalesce(F.col("_last_customer.amt"), F.lit(0.0)),
        "cnt_prev_same_type": F.col("_before_type"),
        "cnt_prev_same_desc": F.col("_before_desc"),
        "cnt_prev_same_mcc": F.col("_before_mcc"),
        "cnt_prev_same_subtype": F.col("_before_subtype"),
        "cnt_prev_same_session": F.col("_before_session"),
        "sec_since_prev_same_type": since("_last_type"),
        "sec_since_prev_same_desc": since("_last_desc"),
        "events_before_today": F.col("_before_date"),
    }
    if keep_running:
        features.update({
            "cust_event_idx": n + 1,
            "cust_cum_amt": (total + exact_amount(columns.amt, scale)).cast("double"),
            "cust_cum_amt_sq": (squares + exact_square(columns.amt, scale)).cast("double"),
            "prev_event_us": F.col("_last_customer.at"),
            "prev_amt": F.col("_last_customer.amt"),
            "prev_same_type_us": F.col("_last_type.at"),
            "prev_same_desc_us": F.col("_last_desc.at"),
        })
    return df.select(*base, *[c.alias(name) for name, c in features.items()])
