"""Rolling, gap, session and running-history features."""

from pyspark.sql import functions as F

from ..functions.calendar import DAY_US, HOUR_US
from ..operators.history import HistoryColumns, history_features
from ..operators.rolling import Gap, Rolling, Totals, timeline_features
from .registry import query, with_ev

CUSTOMER = "PARTITION BY customer_id ORDER BY us"


def frame(period, partition=CUSTOMER):
    return f"OVER ({partition} RANGE BETWEEN {period} PRECEDING AND 1 PRECEDING)"


def rolling_query(name, feature, what, period, sql, value="amt", extra_keys=()):
    @query(name, with_ev(f"SELECT event_id, {sql} AS {feature} FROM ev"))
    def _(t):
        spec = Rolling(feature, what, period, value, extra_keys)
        return timeline_features(t.log(), [spec]).select("event_id", feature)


def amount(period):
    return f"CAST(COALESCE(SUM(units) {frame(period)}, 0) AS DOUBLE) / 10000.0::DOUBLE"


def rows(period, partition=CUSTOMER):
    return f"COUNT(*) {frame(period, partition)}"


MCC = "PARTITION BY customer_id, event_type ORDER BY us"
ROW = "ORDER BY us, event_id"

rolling_query("win_3_amt_1h", "amt_1h", "sum", HOUR_US, amount(HOUR_US))
rolling_query("win_4_cnt_1h", "cnt_1h", "count", HOUR_US, rows(HOUR_US))
rolling_query("win_5_amt_24h", "amt_24h", "sum", DAY_US, amount(DAY_US))
rolling_query("win_6_cnt_24h", "cnt_24h", "count", DAY_US, rows(DAY_US))
rolling_query("win_7_avg_amt_7d", "avg_amt_7d", "mean", 7 * DAY_US,
              f"CAST(SUM(units) {frame(7 * DAY_US)} AS DOUBLE) / 10000.0::DOUBLE"
              f" / NULLIF({rows(7 * DAY_US)}, 0)")
rolling_query("win_8_amt_sum_7d", "amt_sum_7d", "sum", 7 * DAY_US, amount(7 * DAY_US))
rolling_query("win_9_amt_30d", "amt_30d", "sum", 30 * DAY_US, amount(30 * DAY_US))
rolling_query("win_10_cnt_30d", "cnt_30d", "count", 30 * DAY_US, rows(30 * DAY_US))
rolling_query("win_11_mcc_count_24h", "mcc_count_24h", "count", DAY_US, rows(DAY_US, MCC),
              extra_keys=("mcc_code",))


def gap_query(name, feature, extra, partition):
    @query(name, with_ev(f"""
SELECT event_id, COALESCE((us - LAG(us) OVER (PARTITION BY {partition} {ROW})) // 1000000, 999999)
  AS {feature} FROM ev"""))
    def _(t):
        return timeline_features(t.log(), gaps=[Gap(feature, extra)]).select("event_id", feature)


gap_query("win_1_seconds_since_prev", "seconds_since_prev", (), "customer_id")
gap_query("win_2_seconds_since_prev_mcc", "seconds_since_prev_mcc", ("mcc_code",),
          "customer_id, event_type")


@query("win_12_unique_mcc_7d", with_ev(f"""
SELECT event_id, COUNT(DISTINCT mcc) {frame(7 * DAY_US)}
  + COALESCE(MAX(CASE WHEN mcc IS NULL THEN 1 END) {frame(7 * DAY_US)}, 0) AS unique_mcc_7d
FROM (SELECT *, NULLIF(event_type, 'view') AS mcc FROM ev)"""))
def _(t):
    """One merchant code is nulled; null counts as a value of its own."""
    df = t.log().withColumn("mcc_code", F.nullif("mcc_code", F.lit("view")))
    spec = Rolling("unique_mcc_7d", "distinct", 7 * DAY_US, "mcc_code")
    return timeline_features(df, [spec]).select("event_id", "unique_mcc_7d")


SESSION = "OVER (PARTITION BY customer_id, session_id)"


@query("win_13_session_amt_sum", with_ev(
    f"SELECT event_id, CAST(SUM(units) {SESSION} AS DOUBLE) / 10000.0::DOUBLE AS session_amt_sum FROM ev"))
def _(t):
    return timeline_features(t.log(), totals=[Totals()]).select("event_id", "session_amt_sum")


@query("win_14_session_cnt", with_ev(f"SELECT event_id, COUNT(*) {SESSION} AS session_cnt FROM ev"))
def _(t):
    return timeline_features(t.log(), totals=[Totals()]).select("event_id", "session_cnt")


@query("win_13_session_causal", with_ev("""
SELECT event_id, COUNT(*) OVER w AS session_cnt,
       CAST(SUM(units) OVER w AS DOUBLE) / 10000.0::DOUBLE AS session_amt_sum
FROM ev WINDOW w AS (PARTITION BY customer_id, session_id ORDER BY us
                     RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def _(t):
    """Session totals that do not look ahead."""
    return timeline_features(t.log(), totals=[Totals(causal=True)]).select(
        "event_id", "session_cnt", "session_amt_sum")


COLUMNS = HistoryColumns(mcc="mcc_code")


def history_query(name, feature, sql, digits=None):
    expression = f"ROUND({sql}, {digits})" if digits is not None else sql

    @query(name, with_ev(f"SELECT event_id, {expression} AS {feature} FROM ev"))
    def _(t):
        out = history_features(t.log(), COLUMNS, keep_running=True)
        value = F.round(feature, digits).alias(feature) if digits is not None else F.col(feature)
        return out.select("event_id", value)


def over(extra="", rows=""):
    keys = "customer_id" + (f", {extra}" if extra else "")
    return f"OVER (PARTITION BY {keys} {ROW} {rows})"


PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
IDX = f"ROW_NUMBER() {over()}"

history_query("win_15_cust_event_idx", "cust_event_idx", IDX)
history_query("win_16_cust_cum_amt", "cust_cum_amt", f"CAST(SUM(units) {over(rows='ROWS UNBOUNDED PRECEDING')} AS DOUBLE) / 10000.0::DOUBLE")
history_query("win_17_cust_cum_amt_sq", "cust_cum_amt_sq",
              f"CAST(SUM(units * units) {over(rows='ROWS UNBOUNDED PRECEDING')} AS DOUBLE) / 100000000.0::DOUBLE")
history_query("win_18_prev_event_us", "prev_event_us", f"LAG(us) {over()}")
history_query("win_19_prev_amt", "prev_amt", f"LAG(amt) {over()}")
history_query("win_20_cnt_prev_same_type", "cnt_prev_same_type", f"ROW_NUMBER() {over('event_type')} - 1")
history_query("win_21_cnt_prev_same_desc", "cnt_prev_same_desc", f"ROW_NUMBER() {over('k')} - 1")
history_query("win_22_cnt_prev_same_mcc", "cnt_prev_same_mcc", f"ROW_NUMBER() {over('event_type')} - 1")
history_query("win_23_cnt_prev_same_subtype", "cnt_prev_same_subtype", f"ROW_NUMBER() {over('sub')} - 1")
history_query("win_24_cnt_prev_same_session", "cnt_prev_same_session",
              f"ROW_NUMBER() {over('session_id')} - 1")
history_query("win_25_prev_same_type_us", "prev_same_type_us", f"LAG(us) {over('event_type')}")
history_query("win_25_prev_same_desc_us", "prev_same_desc_us", f"LAG(us) {over('k')}")
history_query("win_26_cust_prev_events", "cust_prev_events", f"{IDX} - 1")
PRIOR_MEAN = f"COALESCE(CAST(SUM(units) {over(rows=PRIOR)} AS DOUBLE) / 10000.0::DOUBLE / NULLIF({IDX} - 1, 0), 0)"
history_query("win_27_cust_prev_amt_mean", "cust_prev_amt_mean", PRIOR_MEAN)
# exact in whole units: n times the squares less the squared total
PRIOR_STD = f"""COALESCE(SQRT(CAST(({IDX} - 1) * SUM(units * units) {over(rows=PRIOR)}
  - SUM(units) {over(rows=PRIOR)} * SUM(units) {over(rows=PRIOR)} AS DOUBLE)) / NULLIF({IDX} - 1, 0) / 10000.0::DOUBLE, 0)"""
history_query("win_28_cust_prev_amt_std", "cust_prev_amt_std", PRIOR_STD, 8)
history_query("win_29_sec_since_prev_event", "sec_since_prev_event",
              f"COALESCE((us - LAG(us) {over()}) // 1000000, -1)")
history_query("win_30_amt_delta_prev", "amt_delta_prev", f"amt - COALESCE(LAG(amt) {over()}, 0)")
history_query("win_31_sec_since_prev_same_type", "sec_since_prev_same_type",
              f"COALESCE((us - LAG(us) {over('event_type')}) // 1000000, -1)")
history_query("win_32_sec_since_prev_same_desc", "sec_since_prev_same_desc",
              f"COALESCE((us - LAG(us) {over('k')}) // 1000000, -1)")
history_query("win_33_events_before_today", "events_before_today",
              f"ROW_NUMBER() {over('CAST(ts AS DATE)')} - 1")
