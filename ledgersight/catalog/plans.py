"""Whole jobs: velocity tables, the full feature table, blended scores and reports."""

from pyspark.sql import functions as F

from ..functions.calendar import DAY_US, HOUR_US
from ..functions.hashing import portable_bucket
from ..models import boosting
from ..plans import full, reports
from ..plans.velocity import VelocityConfig, scored_rows, tagged_features, training_rows, velocity
from ..operators.lineage import materialise
from ..operators.history import history_features
from ..operators.periods import hot_customers
from ..operators.skew import SkewPolicy
from .inputs import DISAGREEMENT, prediction_files
from .registry import (HOLDOUT_START, LAB, PER, PRETEST_FROM, RECENT_BORDER, SAMPLE_BORDER, SCO, TEST_FROM,
                       TRAIN_FROM, md5_number, query, with_ev)
from .windows import COLUMNS, MCC, PRIOR, PRIOR_MEAN, PRIOR_STD, amount, frame, over, rows

VELOCITY = f"""vel AS (
  SELECT *, hour(ts) AS hour, isodow(ts) AS day_of_week, CAST(hour(ts) < 6 AS BIGINT) AS is_night,
    COALESCE((us - LAG(us) OVER (PARTITION BY customer_id ORDER BY us, event_id)) // 1000000, 999999) AS seconds_since_prev,
    COALESCE((us - LAG(us) OVER (PARTITION BY customer_id, event_type ORDER BY us, event_id)) // 1000000, 999999)
      AS seconds_since_prev_mcc,
    {amount(HOUR_US)} AS amt_1h, {rows(HOUR_US)} AS cnt_1h, {amount(DAY_US)} AS amt_24h, {rows(DAY_US)} AS cnt_24h,
    CAST(SUM(units) {frame(7 * DAY_US)} AS DOUBLE) / 10000.0::DOUBLE / NULLIF({rows(7 * DAY_US)}, 0) AS avg_amt_7d,
    {amount(7 * DAY_US)} AS amt_sum_7d, {amount(30 * DAY_US)} AS amt_30d, {rows(30 * DAY_US)} AS cnt_30d,
    {rows(DAY_US, MCC)} AS mcc_count_24h, COUNT(DISTINCT event_type) {frame(7 * DAY_US)} AS unique_mcc_7d,
    CAST(SUM(units) OVER (PARTITION BY customer_id, session_id) AS DOUBLE) / 10000.0::DOUBLE AS session_amt_sum,
    COUNT(*) OVER (PARTITION BY customer_id, session_id) AS session_cnt
  FROM src)"""
VELOCITY_COLUMNS = """hour, day_of_week, is_night, seconds_since_prev, seconds_since_prev_mcc, amt_1h, cnt_1h,
  amt_24h, cnt_24h, avg_amt_7d, amt_sum_7d, amt_30d, cnt_30d, mcc_count_24h, unique_mcc_7d, session_amt_sum, session_cnt,
  cnt_1h / (cnt_24h + 1.0::DOUBLE) AS ratio_cnt_1h_24h, amt / NULLIF(amt_24h + 1.0::DOUBLE, 0) AS ratio_amt_24h,
  amt / NULLIF(avg_amt_7d + 1.0::DOUBLE, 0) AS ratio_amt_7d, cnt_1h / (cnt_30d + 1.0::DOUBLE) AS ratio_cnt_1h_30d"""
FEATURES = [
    "hour", "day_of_week", "is_night", "seconds_since_prev", "seconds_since_prev_mcc", "amt_1h", "cnt_1h",
    "amt_24h", "cnt_24h", "avg_amt_7d", "amt_sum_7d", "amt_30d", "cnt_30d", "mcc_count_24h", "unique_mcc_7d",
    "session_amt_sum", "session_cnt", "ratio_cnt_1h_24h", "ratio_amt_24h", "ratio_amt_7d", "ratio_cnt_1h_30d"]


@query("job_velocity_features", with_ev(
    f"SELECT event_id, {VELOCITY_COLUMNS} FROM vel", "src AS (SELECT * FROM ev)", VELOCITY))
def velocity_features(t):
    """The whole velocity block over the event log: one shuffle."""
    return velocity(t.log(), amount="amt").select("event_id", *FEATURES)


SPLIT = SkewPolicy(hot_rows=60, broadcast_rows=100)


@query("job_velocity_features_split", with_ev(
    f"SELECT event_id, {VELOCITY_COLUMNS} FROM vel", "src AS (SELECT * FROM ev)", VELOCITY))
def _(t):
    """The same table with the limits set so low that most customers take the split route."""
    return velocity(t.log(), amount="amt", policy=SPLIT).select("event_id", *FEATURES)


@query("job_history_features_split", with_ev(f"""
SELECT event_id, ROW_NUMBER() {over()} - 1 AS cust_prev_events, {PRIOR_MEAN} AS cust_prev_amt_mean,
  ROUND({PRIOR_STD}, 8) AS cust_prev_amt_std, ROW_NUMBER() {over('event_type')} - 1 AS cnt_prev_same_mcc,
  COALESCE((us - LAG(us) {over()}) // 1000000, -1) AS sec_since_prev_event,
  amt - COALESCE(LAG(amt) {over()}, 0) AS amt_delta_prev,
  ROW_NUMBER() {over('event_type')} - 1 AS cnt_prev_same_type, ROW_NUMBER() {over('k')} - 1 AS cnt_prev_same_desc,
  ROW_NUMBER() {over('sub')} - 1 AS cnt_prev_same_subtype, ROW_NUMBER() {over('session_id')} - 1 AS cnt_prev_same_session,
  COALESCE((us - LAG(us) {over('event_type')}) // 1000000, -1) AS sec_since_prev_same_type,
  COALESCE((us - LAG(us) {over('k')}) // 1000000, -1) AS sec_since_prev_same_desc,
  ROW_NUMBER() {over('CAST(ts AS DATE)')} - 1 AS events_before_today FROM ev"""))
def _(t):
    """The history block with most customers spread over time slices."""
    out = history_features(t.log(), COLUMNS, policy=SPLIT)
    return out.select(
        "event_id", "cust_prev_events", "cust_prev_amt_mean", F.round("cust_prev_amt_std", 8).alias("cust_prev_amt_std"),
        "cnt_prev_same_mcc", "sec_since_prev_event", "amt_delta_prev", "cnt_prev_same_type", "cnt_prev_same_desc", "cnt_prev_same_subtype", "cnt_prev_same_session",
        "sec_since_prev_same_type", "sec_since_prev_same_desc", "events_before_today")


# raw events: text timestamps hold whole seconds
SECONDS = """sec AS (
  SELECT * REPLACE (date_trunc('second', ts) AS ts, epoch_us(date_trunc('second', ts)) AS us) FROM lg)"""


def raw_periods(t):
    return {p: df.drop("event_ts") for p, df in t.periods(t.raw()).items()}


@query("job_training_rows", with_ev(f"""
SELECT event_id, COALESCE(target, 0) AS target, event_type AS mcc_code, 'MISSING' AS browser_language, {VELOCITY_COLUMNS}
FROM vel WHERE ts >= TIMESTAMP '{TRAIN_FROM}' AND (target = 1 OR {md5_number('event_id')} % 100 < 10)""",
                                    LAB, PER, SECONDS,
                                    "src AS (SELECT * FROM sec WHERE period IN ('pretrain', 'train'))", VELOCITY))
def _(t):
    """History joins the windows, training dates are kept, normal rows are sampled at the end."""
    cut = raw_periods(t)
    config = VelocityConfig(start=TRAIN_FROM, hasher=portable_bucket)
    out = training_rows(cut["pretrain"], cut["train"], t.labels(), config)
    return out.select("event_id", "target", "mcc_code", "browser_language", *FEATURES)


@query("job_training_rows_labelled", with_ev(f"""
SELECT event_id, target, {VELOCITY_COLUMNS} FROM vel
WHERE ts >= TIMESTAMP '{TRAIN_FROM}' AND target IS NOT NULL AND (target = 1 OR {md5_number('event_id')} % 50 < 1)""",
                                             LAB, PER, SECONDS, f"""src AS (
  SELECT * FROM sec WHERE period IN ('pretrain', 'train') AND ts >= TIMESTAMP '{TRAIN_FROM}' - INTERVAL 3 DAYS)""",
                                             VELOCITY))
def _(t):
    """Unlabelled rows dropped, history bounded to three days, one in fifty negatives."""
    cut = raw_periods(t)
    config = VelocityConfig(start=TRAIN_FROM, history_days=3, label_rule="labelled", sample_keep=1,
                            sample_modulus=50, hasher=portable_bucket)
    return training_rows(cut["pretrain"], cut["train"], t.labels(), config).select("event_id", "target", *FEATURES)


@query("job_training_rows_rotated", with_ev(f"""
SELECT event_id, COALESCE(target, 0) AS target, {VELOCITY_COLUMNS} FROM vel WHERE ts >= TIMESTAMP '{TRAIN_FROM}'""",
                                            LAB, PER, SECONDS, f"""src AS (
  SELECT * FROM sec WHERE period = 'train' AND (target = 1 OR ({md5_number('event_id')} % 100 + 13) % 100 < 5))""",
                                            VELOCITY))
def _(t):
    """The second stacking fold: negatives rotated by 13 and sampled before the windows."""
    config = VelocityConfig(start=TRAIN_FROM, sample_keep=5, sample_offset=13, sample_stage="before",
                            hasher=portable_bucket)
    return training_rows(None, raw_periods(t)["train"], t.labels(), config).select("event_id", "target", *FEATURES)


@query("job_scored_rows", with_ev(f"""
SELECT event_id, event_type AS mcc_code, {VELOCITY_COLUMNS} FROM vel WHERE period = 'test'""",
                                  LAB, PER, SECONDS, """src AS (
  SELECT * FROM sec WHERE period = 'test' OR (period IN ('train', 'pretest')
    AND customer_id IN (SELECT customer_id FROM lg WHERE period = 'test')))""", VELOCITY))
def _(t):
    cut = raw_periods(t)
    history = cut["train"].unionByName(cut["pretest"])
    return scored_rows(history, cut["test"]).select("event_id", "mcc_code", *FEATURES)


@query("job_scored_rows_bounded", with_ev(f"""
SELECT event_id, {VELOCITY_COLUMNS} FROM vel WHERE period = 'test'""",
                                          LAB, PER, SECONDS, f"""src AS (
  SELECT * FROM sec WHERE period = 'test' OR (period IN ('train', 'pretest')
    AND ts >= TIMESTAMP '{TEST_FROM}' - INTERVAL 5 DAYS
    AND customer_id IN (SELECT customer_id FROM lg WHERE period = 'test')))""", VELOCITY))
def _(t):
    """History of scored customers bounded to five days before the scored period."""
    cut = raw_periods(t)
    config = VelocityConfig(scored_start=TEST_FROM, scored_history_days=5)
    history = cut["train"].unionByName(cut["pretest"])
    return scored_rows(history, cut["test"], config).select("event_id", *FEATURES)


@query("job_tagged_features", with_ev(f"""
SELECT event_id, CASE period WHEN 'pretrain' THEN 'pre_train' WHEN 'pretest' THEN 'pre_test' ELSE period END AS split_group,
       CASE WHEN period = 'train' THEN target END AS target, {VELOCITY_COLUMNS} FROM vel""",
                                      LAB, PER, SECONDS, "src AS (SELECT * FROM sec)", VELOCITY))
def _(t):
    return tagged_features(raw_periods(t), t.labels()).select("event_id", "split_group", "target", *FEATURES)


# --- full job -------------------------------------------------------------------------

def full_periods(t):
    """Raw events with every column of the full layout, codes as text."""
    e = t.table("events")
    ts = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("int")
    code = F.ascii("event_type")

    def text(c):
        return c.cast("string")

    raw = e.select(
        "event_id", F.col("user_id").alias("customer_id"), ts.alias("event_ts"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("event_dttm"), F.col("value").alias("operaton_amt"),
        text(code).alias("event_type_nm"), text(k).alias("event_desc"),
        text(k % 3).alias("channel_indicator_type"), text(k % 10).alias("channel_indicator_sub_type"),
        text(k % 4).alias("currency_iso_cd"), text(code % 7).alias("mcc_code"), text(k % 5).alias("pos_cd"),
        F.when(k % 6 > 0, text(k % 6)).alias("timezone"), text(F.unix_date(F.to_date(ts))).alias("session_id"),
        text(k % 2).alias("operating_system_type"), F.concat(text(k), F.lit("%")).alias("battery"),
        F.concat(text(k), F.lit(".1")).alias("device_system_version"),
        F.concat(text(k * 10), F.lit("x"), text(k * 20)).alias("screen_size"), text(k % 2).alias("developer_tools"),
        F.lit("no").alias("phone_voip_call_state"), text(k % 2).alias("web_rdp_connection"),
        F.lit(None).cast("string").alias("compromised"))
    return {p: df.drop("event_ts") for p, df in t.periods(raw).items()}


CONFIG = full.FullConfig(
    sample_border=SAMPLE_BORDER, recent_border=RECENT_BORDER, holdout_start=HOLDOUT_START, refit_least=6,
    hasher=portable_bucket, learner=boosting.Boosting(iterations=5, step=0.3, depth=3))

def feature_table(t):
    """(feature table, labelled log) over the four periods."""
    frames = full_periods(t)
    hot = hot_customers(frames.values())
    log = full.labelled_log(frames, t.labels(), hot=hot)
    return full.feature_table(log, CONFIG, hot=hot), log


FULL = f"""red AS (
  SELECT *, ascii(event_type)::BIGINT AS etype, ascii(event_type)::BIGINT % 7 AS mcc,
         CASE WHEN k % 6 > 0 THEN k % 6 ELSE -1 END AS tz FROM sec
  WHERE period IN ('pretrain', 'train') OR customer_id IN (SELECT customer_id FROM lg WHERE period = 'pretrain')),
his AS (
  SELECT *,
    ROW_NUMBER() {over()} - 1 AS cust_prev_events,
    {PRIOR_MEAN} AS prev_mean, COALESCE(STDDEV_POP(amt) {over(rows=PRIOR)}, 0) AS prev_std,
    COALESCE((us - LAG(us) {over()}) // 1000000, -1) AS sec_since_prev_event,
    amt - COALESCE(LAG(amt) {over()}, 0) AS amt_delta_prev,
    ROW_NUMBER() {over('etype')} - 1 AS cnt_prev_same_type, ROW_NUMBER() {over('k')} - 1 AS cnt_prev_same_desc,
    ROW_NUMBER() {over('mcc')} - 1 AS cnt_prev_same_mcc, ROW_NUMBER() {over('sub')} - 1 AS cnt_prev_same_subtype,
    ROW_NUMBER() {over('session_id')} - 1 AS cnt_prev_same_session,
    COALESCE((us - LAG(us) {over('etype')}) // 1000000, -1) AS sec_since_prev_same_type,
    COALESCE((us - LAG(us) {over('k')}) // 1000000, -1) AS sec_since_prev_same_desc,
    ROW_NUMBER() {over('CAST(ts AS DATE)')} - 1 AS events_before_today,
    period = 'train' AND (raw <> -1
      OR (ts >= TIMESTAMP '{SAMPLE_BORDER}' AND {md5_number('event_id', 'customer_id', "'42'")} % 10 = 0)
      OR (ts < TIMESTAMP '{SAMPLE_BORDER}' AND {md5_number('event_id', 'customer_id', "'59'")} % 30 = 0)) AS is_train_sample
  FROM red)"""
FULL_COLUMNS = """event_id, period, us AS event_us, is_train_sample, period = 'test' AS is_test, raw AS train_target_raw,
  CASE WHEN is_train_sample THEN CAST(raw = 1 AS BIGINT) END AS target_bin, customer_id, etype AS event_type_nm,
  k AS event_desc, k % 3 AS channel_indicator_type, sub AS channel_indicator_sub_type, k % 4 AS currency_iso_cd,
  mcc AS mcc_code_i, k % 5 AS pos_cd, tz AS timezone, k % 2 AS operating_system_type,
  CAST(-1 AS BIGINT) AS phone_voip_call_state, k % 2 AS web_rdp_connection, k % 2 AS developer_tools_i,
  CAST(-1 AS BIGINT) AS compromised_i, amt, ROUND(ln(1 + abs(amt)), 9) AS amt_log_abs, CAST(amt < 0 AS BIGINT) AS amt_is_negative,
  hour(ts) AS hour, isodow(ts) AS weekday, day(ts) AS day, month(ts) AS month, CAST(isodow(ts) >= 5 AS BIGINT) AS is_weekend,
  us // 86400000000 AS event_day_number, k AS battery_pct, k AS os_ver_major, k * 10 AS screen_w, k * 20 AS screen_h,
  k * 10 * k * 20 AS screen_pixels, CASE WHEN k > 0 THEN (k * 10)::DOUBLE / (k * 20)::DOUBLE ELSE 0 END AS screen_ratio,
  session_id, cust_prev_events, prev_mean AS cust_prev_amt_mean, ROUND(prev_std, 4) AS cust_prev_amt_std,
  sec_since_prev_event, amt_delta_prev, cnt_prev_same_type, cnt_prev_same_desc, cnt_prev_same_mcc, cnt_prev_same_subtype,
  cnt_prev_same_session, sec_since_prev_same_type, sec_since_prev_same_desc, events_before_today"""


def rounded(df):
    digits = {"amt_log_abs": 9, "cust_prev_amt_std": 4}
    df = df.withColumns({c: F.round(c, d) for c, d in digits.items()})
    return df.withColumn("event_us", F.unix_micros("event_ts")).drop("event_ts")


@query("job_full_feature_table", with_ev(
    f"SELECT {FULL_COLUMNS} FROM his WHERE is_train_sample OR period = 'test'", LAB, PER, SECONDS, FULL))
def _(t):
    """7 meta columns and 43 features of sampled training rows and test rows."""
    return rounded(feature_table(t)[0])


@query("job_full_with_priors", with_ev(f"""
, pri AS (SELECT etype, COUNT(*) AS cnt, (COALESCE(SUM(target), 0) + 1.0::DOUBLE) / (COUNT(*) + 200.0::DOUBLE) AS red_rate
  FROM red WHERE period = 'train' AND ts < TIMESTAMP '{HOLDOUT_START}' GROUP BY etype),
tzp AS (SELECT tz, (COUNT(target) + 1.0::DOUBLE) / (COUNT(*) + 200.0::DOUBLE) AS lbl_rate
  FROM red WHERE period = 'train' AND ts < TIMESTAMP '{HOLDOUT_START}' GROUP BY tz)
SELECT event_id, CAST(71 AS BIGINT) AS features, CAST(cnt AS DOUBLE) AS prior_event_type_nm_cnt,
       red_rate AS prior_event_type_nm_red_rate_all, lbl_rate AS prior_timezone_labeled_rate_all
FROM his JOIN pri USING (etype) JOIN tzp USING (tz) WHERE is_train_sample OR period = 'test'""",
                                       LAB, PER, SECONDS, FULL).replace(")\n\n, pri", "),\npri", 1))
def _(t):
    """The feature table with 7 x 4 leak-free priors: 71 features."""
    from ..operators.normalise import feature_columns
    table = full.with_priors(*feature_table(t), CONFIG)
    return table.select(
        "event_id", F.lit(len(feature_columns(table.columns)[0])).alias("features"), "prior_event_type_nm_cnt",
        "prior_event_type_nm_red_rate_all", "prior_timezone_labeled_rate_all")


@query("job_full_blended_scores")
def _(t):
    """Four models, searched blend, refit, and a score for every test event."""
    table = materialise(full.with_priors(*feature_table(t), CONFIG))
    scores, *_ = full.run(table, CONFIG)
    template = table.where("is_test").select("event_id")
    return full.submit(scores, template)


# --- reports ---------------------------------------------------------------------------

@query("job_disagreement_report", with_ev(DISAGREEMENT, LAB, SCO))
def _(t):
    report = reports.prediction_report(prediction_files(t))
    return report["disagreement"]


@query("job_class_report")
def _(t):
    log = t.log().withColumnRenamed("amt", "operaton_amt")
    return reports.class_report(log, t.labels())["class_density"]
