"""Scalar functions."""

from pyspark.sql import functions as F

from ..functions import amounts, calendar, casts, probability, rowwise
from ..functions.hashing import bucket, portable_bucket
from ..operators import normalise
from ..plans.velocity import ratios
from ..operators.rolling import DAY_US, HOUR_US, Rolling, timeline_features
from .registry import DEV, LAB, SCO, md5_number, query, with_ev
from .windows import amount, frame, rows


@query("fn_1_hour", with_ev("SELECT event_id, hour(ts) AS hour FROM ev"))
def _(t):
    return t.log().select("event_id", F.hour("event_ts").alias("hour"))


@query("fn_2_iso_weekday", with_ev("SELECT event_id, isodow(ts) AS weekday FROM ev"))
def _(t):
    return t.log().select("event_id", calendar.iso_weekday("event_ts").alias("weekday"))


@query("fn_3_day_month", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, "
       "day(l_shipdate) AS day, month(l_shipdate) AS month FROM lineitem")
def _(t):
    parts = calendar.calendar_features("l_shipdate")
    return t.table("lineitem").select("l_orderkey", "l_linenumber", parts["day"].alias("day"),
                                      parts["month"].alias("month"))


@query("fn_4_is_night", with_ev("SELECT event_id, CAST(hour(ts) < 6 AS BIGINT) AS is_night FROM ev"))
def _(t):
    return t.log().select("event_id", calendar.is_night("event_ts").alias("is_night"))


@query("fn_5_is_weekend", with_ev("""
SELECT event_id, CAST(isodow(ts) >= 5 AS BIGINT) AS is_weekend,
       CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend_strict FROM ev"""))
def _(t):
    return t.log().select("event_id", calendar.is_weekend("event_ts").alias("is_weekend"),
                          calendar.is_weekend("event_ts", 6).alias("is_weekend_strict"))


@query("fn_6_event_day_number", with_ev("SELECT event_id, us // 86400000000 AS event_day_number FROM ev"))
def _(t):
    return t.log().select("event_id", calendar.day_number("event_ts").alias("event_day_number"))


@query("fn_7_event_date", with_ev("SELECT event_id, strftime(ts, '%Y-%m-%d') AS event_date FROM ev"))
def _(t):
    date = calendar.calendar_features("event_ts")["event_date"]
    return t.log().select("event_id", date.cast("string").alias("event_date"))


@query("fn_8_whole_seconds", with_ev("""
SELECT event_id, (us - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS seconds FROM ev"""))
def _(t):
    start = calendar.micros(F.lit("2024-01-01").cast("timestamp"))
    return t.log().select("event_id", calendar.seconds_between("event_us", start).alias("seconds"))


@query("fn_9_minus_days", with_ev("SELECT event_id, epoch_us(ts - INTERVAL 90 DAYS) AS history_us FROM ev"))
def _(t):
    return t.log().select("event_id", calendar.micros(calendar.minus_days("event_ts", 90)).alias("history_us"))


@query("fn_10_amt_log_abs", with_ev("SELECT event_id, ROUND(ln(1 + abs(amt - 50)), 9) AS amt_log_abs FROM ev"))
def _(t):
    return t.log().select("event_id", F.round(amounts.log_abs(F.col("amt") - 50), 9).alias("amt_log_abs"))


@query("fn_11_amt_is_negative", with_ev("SELECT event_id, CAST(amt - 50 < 0 AS BIGINT) AS amt_is_negative FROM ev"))
def _(t):
    return t.log().select("event_id", amounts.is_negative(F.col("amt") - 50).alias("amt_is_negative"))


def digits_sql(column, pattern, name):
    return f"CAST(COALESCE(TRY_CAST(regexp_extract({column}, '{pattern}', 1) AS SMALLINT), -1) AS BIGINT) AS {name}"


W, H = digits_sql("screen_size", r"^(\d+)", "screen_w"), digits_sql("screen_size", r"x(\d+)$", "screen_h")


def devices(t):
    from .. import fixed_values as fv
    return t.devices().withColumns({
        name: casts.digits(source, pattern) for name, (source, pattern) in fv.DIGIT_PATTERNS.items()})


@query("fn_12_screen_pixels", f"""WITH {DEV}, px AS (SELECT event_id, {W}, {H} FROM dev)
SELECT event_id, screen_w * screen_h AS screen_pixels FROM px""")
def _(t):
    return devices(t).select("event_id", amounts.screen_pixels().alias("screen_pixels"))


@query("fn_13_screen_ratio", f"""WITH {DEV}, px AS (SELECT event_id, {W}, {H} FROM dev)
SELECT event_id, CASE WHEN screen_h > 0 AND screen_w > 0
  THEN CAST(screen_w AS DOUBLE) / CAST(screen_h AS DOUBLE) ELSE 0.0::DOUBLE END AS screen_ratio FROM px""")
def _(t):
    return devices(t).select("event_id", amounts.screen_ratio().alias("screen_ratio"))


@query("fn_14_battery_pct", f"WITH {DEV} SELECT event_id, "
       + digits_sql("battery", r"(\d{1,3})", "battery_pct") + " FROM dev")
def _(t):
    return devices(t).select("event_id", "battery_pct")


@query("fn_15_os_ver_major", f"WITH {DEV} SELECT event_id, "
       + digits_sql("device_system_version", r"^(\d+)", "os_ver_major") + " FROM dev")
def _(t):
    return devices(t).select("event_id", "os_ver_major")


@query("fn_16_screen_size", f"WITH {DEV} SELECT event_id, {W}, {H} FROM dev")
def _(t):
    return devices(t).select("event_id", "screen_w", "screen_h")


@query("fn_17_to_20_ratios", with_ev(f"""
SELECT event_id, cnt_1h / (cnt_24h + 1.0::DOUBLE) AS ratio_cnt_1h_24h,
       amt / NULLIF(amt_24h + 1.0::DOUBLE, 0) AS ratio_amt_24h,
       amt / NULLIF(avg_7d + 1.0::DOUBLE, 0) AS ratio_amt_7d,
       cnt_1h / (cnt_30d + 1.0::DOUBLE) AS ratio_cnt_1h_30d
FROM (SELECT event_id, amt, {rows(HOUR_US)} AS cnt_1h, {rows(DAY_US)} AS cnt_24h,
        {rows(30 * DAY_US)} AS cnt_30d, {amount(DAY_US)} AS amt_24h,
        CAST(SUM(units) {frame(7 * DAY_US)} AS DOUBLE) / 10000.0::DOUBLE / NULLIF({rows(7 * DAY_US)}, 0) AS avg_7d
      FROM ev)"""))
def _(t):
    specs = [Rolling("cnt_1h", "count", HOUR_US), Rolling("cnt_24h", "count", DAY_US),
             Rolling("cnt_30d", "count", 30 * DAY_US), Rolling("amt_24h", "sum", DAY_US),
             Rolling("avg_amt_7d", "mean", 7 * DAY_US)]
    return timeline_features(t.log(), specs).select(
        "event_id", *[c.alias(n) for n, c in ratios("amt").items()])


@query("fn_21_clip_sqrt", with_ev("SELECT event_id, sqrt(GREATEST(amt - 50, 0)) AS root FROM ev"))
def _(t):
    return t.log().select("event_id", F.sqrt(probability.clip(F.col("amt") - 50, 0.0, 1e300)).alias("root"))


PRESENT = "[x FOR x IN [p1, CASE WHEN p2 > 0.5 THEN p2 END, p3] IF x IS NOT NULL]"


@query("fn_22_row_mean", with_ev(f"""
SELECT event_id, list_sum(v) / len(v) AS mean_pred FROM (SELECT event_id, {PRESENT} AS v FROM sco)""", LAB, SCO))
def _(t):
    p2 = F.when(F.col("p2") > 0.5, F.col("p2"))
    return t.scores().select("event_id", rowwise.row_mean(["p1", p2, "p3"]).alias("mean_pred"))


@query("fn_23_row_std", with_ev(f"""
SELECT event_id, ROUND(CASE WHEN len(v) > 1 THEN list_stddev_samp(v) END, 9) AS std_pred
FROM (SELECT event_id, {PRESENT} AS v FROM sco)""", LAB, SCO))
def _(t):
    p2 = F.when(F.col("p2") > 0.5, F.col("p2"))
    return t.scores().select("event_id", F.round(rowwise.row_std(["p1", p2, "p3"]), 9).alias("std_pred"))


SIGMOID = "1 / (1 + exp(-GREATEST(LEAST({x}, 40), -40)))"
LOGIT = "ln({p} / (1 - {p}))"


def clip_sql(p):
    return f"GREATEST(LEAST({p}, 1 - 1e-8::DOUBLE), 1e-8::DOUBLE)"


@query("fn_24_sigmoid", with_ev("SELECT event_id, ROUND(" + SIGMOID.format(x="(amt - 50)") + ", 9) AS p FROM ev"))
def _(t):
    return t.log().select("event_id", F.round(probability.sigmoid(F.col("amt") - 50), 9).alias("p"))


@query("fn_25_logit", with_ev("SELECT event_id, ROUND(" + LOGIT.format(p="q") + f""", 6) AS log_odds
FROM (SELECT event_id, {clip_sql('(amt - 10) / 400')} AS q FROM ev)"""))
def _(t):
    return t.log().select("event_id", F.round(probability.logit((F.col("amt") - 10) / 400.0), 6).alias("log_odds"))


@query("fn_26_portable_hash", with_ev(f"""
SELECT event_id, {md5_number('event_id')} % 100 AS bucket,
       {md5_number('event_id', 'customer_id', "'42'")} % 100 AS seeded FROM ev"""))
def _(t):
    return t.log().select("event_id", portable_bucket("event_id", 100).alias("bucket"),
                          portable_bucket(["event_id", "customer_id"], 100, 42).alias("seeded"))


@query("fn_26_native_hash")
def _(t):
    return t.log().select("event_id", bucket(["event_id", "customer_id"], 100, 42).alias("bucket"))
