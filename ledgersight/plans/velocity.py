"""Velocity feature tables for training and scoring."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import amounts, calendar
from ..functions.hashing import bucket
from ..functions.labels import unlabelled_as_negative
from ..operators import normalise, periods, sampling
from ..operators.rolling import Gap, Totals, timeline_features, velocity_specs
from ..operators.skew import DEFAULT_POLICY, SkewPolicy


@dataclass(frozen=True)
class VelocityConfig:
    """Choices that differ between runs.

    label_rule: "negative" counts unlabelled rows as 0, "labelled" drops them.
    sample_stage: "after" samples finished feature rows; "before" samples raw events, which
    makes the windows of training rows sparser than those of scored rows.
    history_days: None keeps all history of training rows; otherwise this much before the
    start date. scored_history_days: the same for scored rows and their start date.
    """

    start: str = fv.TRAIN_START
    scored_start: str = fv.TEST_START
    history_days: int | None = None
    scored_history_days: int | None = None
    label_rule: str = "negative"
    sample_keep: int | None = 10
    sample_modulus: int = 100
    sample_offset: int = 0
    sample_stage: str = "after"
    customer_modulus: int | None = None
    hasher: object = bucket
    policy: SkewPolicy = DEFAULT_POLICY


def velocity(events: DataFrame, amount: str = "operaton_amt", mcc: str = "mcc_code",
             policy: SkewPolicy = DEFAULT_POLICY, hot="find", scale: int = 4) -> DataFrame:
    """Add the calendar, gap, rolling, session and ratio features to an event log.

    Needs event_id, customer_id, event_ts, event_us and the amount; merchant code and
    session features appear when their columns exist.
    """
    has_mcc, has_session = mcc in events.columns, "session_id" in events.columns
    specs = [s for s in velocity_specs(amount, mcc) if has_mcc or mcc not in (s.value, *s.extra_keys)]
    gaps = [Gap("seconds_since_prev")] + ([Gap("seconds_since_prev_mcc", (mcc,))] if has_mcc else [])
    totals = [Totals(value=amount)] if has_session else []
    df = timeline_features(events, specs, gaps, totals, scale, policy, hot)
    if not has_mcc:
        df = df.withColumn("seconds_since_prev_mcc", F.lit(fv.FIRST_GAP_SECONDS).cast("bigint"))
    return df.withColumns({
        "hour": F.hour("event_ts"),
        "day_of_week": calendar.iso_weekday("event_ts"),
        "is_night": calendar.is_night("event_ts"),
        **ratios(amount),
    })


def ratios(amount: str = "operaton_amt") -> dict[str, Column]:
    return {
        "ratio_cnt_1h_24h": amounts.ratio_plus_one("cnt_1h", "cnt_24h"),
        "ratio_amt_24h": amounts.ratio_plus_one(amount, "amt_24h"),
        "ratio_amt_7d": amounts.ratio_plus_one(amount, "avg_amt_7d"),
        "ratio_cnt_1h_30d": amounts.ratio_plus_one("cnt_1h", "cnt_30d"),
    }


def training_rows(history: DataFrame | None, train: DataFrame, labels: DataFrame,
                  config: VelocityConfig = VelocityConfig()) -> DataFrame:
    """Feature rows with target, from raw history and training events."""
    parts = [normalise.normalise_strict(df) for df in (history, train) if df is not None]
    events = periods.attach_labels(periods.union_diagonal(*parts), labels, config.policy)
    if config.label_rule == "negative":
        events = events.withColumn("target", unlabelled_as_negative())
    if config.history_days is not None:
        events = periods.since(events, config.start, days_before=config.history_days)
    events = _customers(events, config)
    if config.sample_stage == "before":
        events = _sampled(events, config)
    hot = periods.hot_customers([history, train], config.policy)
    rows = velocity(events, policy=config.policy, hot=hot)
    rows = periods.labelled(periods.since(rows, config.start))
    if config.sample_stage == "after":
        rows = _sampled(rows, config)
    return normalise.normalise_categories(rows)


def scored_rows(history: DataFrame | None, scored: DataFrame,
                config: VelocityConfig = VelocityConfig()) -> DataFrame:
    """Feature rows of the events to score; history serves only their customers."""
    hot = periods.hot_customers([history, scored], config.policy)
    target = periods.tag(normalise.normalise_strict(scored), target=(None, "bigint"), is_submit=1)
    parts = [target]
    if history is not None:
        past = normalise.normalise_strict(history)
        if config.scored_history_days is not None:
            past = periods.since(past, config.scored_start, days_before=config.scored_history_days)
        past = periods.keep_customers(past, periods.customers_of(target), config.policy, hot)
        parts.append(periods.tag(past, target=(None, "bigint"), is_submit=0))
    events = _customers(periods.union_diagonal(*parts), config)
    rows = velocity(events, policy=config.policy, hot=hot).where(F.col("is_submit") == 1)
    return normalise.normalise_categories(rows)


def tagged_features(frames: dict[str, DataFrame], labels: DataFrame,
                    policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """All periods in one log with split_group, labels on train rows, and velocity features."""
    names = {"pretrain": "pre_train", "train": "train", "pretest": "pre_test", "test": "test"}
    parts = []
    for period, df in frames.items():
        df = periods.tag(normalise.normalise_strict(df), split_group=names[period])
        parts.append(periods.attach_labels(df, labels, policy) if period == "train"
                     else periods.tag(df, target=(None, "bigint")))
    hot = periods.hot_customers(frames.values(), policy)
    return normalise.normalise_categories(
        velocity(periods.union_diagonal(*parts), policy=policy, hot=hot))


def _customers(df, config):
    if config.customer_modulus is None:
        return df
    return sampling.keep_customer_sample(df, config.customer_modulus, config.hasher)


def _sampled(df, config):
    if config.sample_keep is None:
        return df
    return sampling.keep_positives(df, config.sample_keep, config.sample_modulus,
                                   offset=config.sample_offset, hasher=config.hasher)
