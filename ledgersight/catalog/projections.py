"""Projections, casts, null handling, filters and samples."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import casts, labels as rules
from ..functions.hashing import bucket, portable_bucket
from ..operators import impute, normalise, periods, sampling, splits
from ..operators.rolling import DAY_US, Rolling, timeline_features
from ..sources.readers import canonical_names
from .registry import (HOLDOUT_START, LAB, PER, SAMPLE_BORDER, md5_number, query, with_ev)


@query("prj_1_existing_columns", with_ev("""
SELECT event_id, customer_id, event_type AS mcc_code, session_id FROM ev"""))
def _(t):
    return normalise.keep_existing(t.log(), fv.ESSENTIAL_COLUMNS)


@query("prj_2_literal_tags", with_ev("""
SELECT event_id, 'train' AS period, CAST(0 AS BIGINT) AS is_submit, CAST(NULL AS BIGINT) AS target
FROM ev"""))
def _(t):
    return periods.tag(t.log().select("event_id"), period="train", is_submit=0,
                       target=(None, "bigint"))


@query("prj_3_strict_timestamp", """
SELECT event_id, epoch_us(date_trunc('second', ts)) AS event_us FROM events""")
def _(t):
    return t.raw().select("event_id", F.unix_micros(casts.strict_timestamp("event_dttm")).alias("event_us"))


@query("prj_4_lenient_timestamp", with_ev("""
SELECT event_id, CASE WHEN k % 7 <> 0 THEN epoch_us(date_trunc('second', ts)) END AS event_us FROM ev"""))
def _(t):
    """Every seventh category carries a month that does not exist."""
    broken = F.when(F.col("event_desc") % 7 == 0, F.regexp_replace("text", "-01-", "-13-")).otherwise(F.col("text"))
    df = t.log().withColumn("text", F.date_format("event_ts", fv.TIMESTAMP_FORMAT))
    return df.select("event_id", F.unix_micros(casts.lenient_timestamp(broken)).alias("event_us"))


TEXT_NUMBER = """CASE k % 5 WHEN 0 THEN 'a' || k WHEN 1 THEN k || '.7' WHEN 2 THEN CAST(k * 400 AS VARCHAR)
  WHEN 3 THEN NULL ELSE CAST(k AS VARCHAR) END"""


def text_number():
    k = F.col("event_desc")
    return (F.when(k % 5 == 0, F.concat(F.lit("a"), k.cast("string")))
            .when(k % 5 == 1, F.concat(k.cast("string"), F.lit(".7")))
            .when(k % 5 == 2, (k * 400).cast("string"))
            .when(k % 5 == 4, k.cast("string")))


@query("prj_5_lenient_integers", with_ev(f"""
SELECT event_id,
  CAST(CASE WHEN regexp_matches(x, '^[0-9]+$') THEN COALESCE(TRY_CAST(x AS TINYINT), -1) ELSE -1 END AS BIGINT) AS as_byte,
  CAST(CASE WHEN regexp_matches(x, '^[0-9]+$') THEN COALESCE(TRY_CAST(x AS SMALLINT), -1) ELSE -1 END AS BIGINT) AS as_short,
  CAST(CASE WHEN regexp_matches(x, '^[0-9]+$') THEN COALESCE(TRY_CAST(x AS INTEGER), -1) ELSE -1 END AS BIGINT) AS as_int
FROM (SELECT event_id, {TEXT_NUMBER} AS x FROM ev)"""))
def _(t):
    x = text_number()
    return t.log().select(
        "event_id", casts.lenient_int(x, "tinyint").alias("as_byte"),
        casts.lenient_int(x, "smallint").alias("as_short"), casts.lenient_int(x, "int").alias("as_int"))


@query("prj_6_strict_casts", with_ev("SELECT event_id, customer_id, k AS target FROM ev"))
def _(t):
    df = t.log()
    return df.select(F.col("event_id").cast("string").cast("bigint").alias("event_id"),
                     F.col("customer_id").cast("string").cast("bigint").alias("customer_id"),
                     F.col("event_desc").cast("string").cast("bigint").alias("target"))


@query("prj_7_null_fill", with_ev("""
SELECT event_id, COALESCE(target, 0) AS target FROM ev LEFT JOIN lab USING (event_id)""", LAB))
def _(t):
    df = periods.attach_by_event(t.log(), t.labels())
    return df.select("event_id", rules.unlabelled_as_negative().alias("target"))


@query("prj_8_category_text", with_ev("""
SELECT event_id, COALESCE(CAST(CASE WHEN k >= 20 THEN k END AS VARCHAR), 'MISSING') AS pos_cd,
       'MISSING' AS browser_language FROM ev"""))
def _(t):
    df = t.log().select("event_id", F.when(F.col("event_desc") >= 20, F.col("event_desc")).alias("pos_cd"))
    return normalise.normalise_categories(df, ["pos_cd", "browser_language"])


@query("prj_9_rename_drop", with_ev("SELECT event_id, k AS channel_indicator_sub_type FROM ev"))
def _(t):
    df = t.log().select("event_id", F.col("event_desc").alias("channel_indicator_subtype"), "amt")
    return canonical_names(df).drop("amt")


@query("prj_10_three_way_label", with_ev(
    "SELECT event_id, period, raw AS train_target_raw FROM lg", LAB, PER))
def _(t):
    return t.period_log().select("event_id", "period", "train_target_raw")


BORDER = f"TIMESTAMP '{SAMPLE_BORDER}'"
H10 = md5_number("event_id", "customer_id", "'42'") + " % 10 = 0"
H30 = md5_number("event_id", "customer_id", "'59'") + " % 30 = 0"
SAMPLED = f"""smp AS (
  SELECT *, period = 'train' AND (raw <> -1 OR (ts >= {BORDER} AND {H10}) OR (ts < {BORDER} AND {H30}))
    AS is_train_sample, period = 'test' AS is_test FROM lg)"""


def sampled(t):
    return sampling.mark_samples(t.period_log(), SAMPLE_BORDER, hasher=portable_bucket)


@query("prj_11_binary_target", with_ev("""
SELECT event_id, CASE WHEN is_train_sample THEN CAST(raw = 1 AS BIGINT) END AS target_bin FROM smp""",
                                       LAB, PER, SAMPLED))
def _(t):
    return sampled(t).select("event_id", rules.red_vs_rest().alias("target_bin"))


@query("prj_12_numeric_columns", """
SELECT l_linenumber::BIGINT AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""")
def _(t):
    df = t.table("lineitem")
    return df.select(*normalise.numeric_columns(df, ("l_orderkey", "l_partkey", "l_suppkey")))


@query("prj_13_feature_list", with_ev("""
SELECT event_type AS event_type_nm, k AS event_desc, sub AS channel_indicator_sub_type, customer_id,
       amt, session_id FROM ev"""))
def _(t):
    df = t.log().drop("event_us", "mcc_code").withColumn("target", F.lit(1))
    features, _, _ = normalise.feature_columns(df.columns)
    return df.select(*features)


NULLED = "SELECT event_id, customer_id, event_type, CASE WHEN k < 90 THEN amt END AS amt, k FROM ev"


def with_nulls(t):
    return t.log().withColumn("amt", F.when(F.col("event_desc") < 90, F.col("amt")))


@query("prj_14_mean_imputation", with_ev(f"""
SELECT event_id, ROUND(COALESCE(amt, AVG(amt) OVER ()), 6) AS amt FROM ({NULLED})"""))
def _(t):
    return impute.fill_means(with_nulls(t), ["amt"]).select("event_id", F.round("amt", 6).alias("amt"))


@query("prj_15_median_imputation", with_ev(f"""
SELECT event_id, ROUND(COALESCE(amt, (SELECT MEDIAN(amt) FROM n)), 6) AS amt FROM n""", f"n AS ({NULLED})"))
def _(t):
    return impute.fill_medians(with_nulls(t), ["amt"]).select("event_id", F.round("amt", 6).alias("amt"))


@query("prj_16_category_fill", with_ev("SELECT event_id, CASE WHEN k >= 20 THEN k ELSE -1 END AS pos_cd FROM ev"))
def _(t):
    df = t.log().select("event_id", F.when(F.col("event_desc") >= 20, F.col("event_desc")).alias("pos_cd"))
    return impute.fill_categories(df, ["pos_cd"])


@query("prj_17_numeric_coercion", with_ev(f"""
SELECT event_id, TRY_CAST({TEXT_NUMBER} AS DOUBLE) AS x FROM ev"""))
def _(t):
    return normalise.coerce_numeric(t.log().select("event_id", text_number().alias("x")), ["x"])


# --- filters ------------------------------------------------------------------------

@query("flt_1_text_date_bound", """
SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%d %H:%M:%S') >= '2024-01-15'""")
def _(t):
    return periods.since_text(t.raw(), SAMPLE_BORDER).select("event_id")


@query("flt_2_bound_after_windows", with_ev(f"""
SELECT event_id, cnt_7d FROM (SELECT event_id, ts, COUNT(*) OVER (PARTITION BY customer_id ORDER BY us
  RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS cnt_7d FROM ev)
WHERE ts >= TIMESTAMP '{SAMPLE_BORDER}'"""))
def _(t):
    return periods.since(_week_counts(t.log()), SAMPLE_BORDER).select("event_id", "cnt_7d")


def _week_counts(df):
    return timeline_features(df, [Rolling("cnt_7d", "count", 7 * DAY_US)])


@query("flt_3_bounded_history", with_ev("""
SELECT event_id, COUNT(*) OVER (PARTITION BY customer_id ORDER BY us
  RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS cnt_7d
FROM ev WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 9 DAYS"""))
def _(t):
    return _week_counts(periods.since(t.log(), "2024-01-20", days_before=9)).select("event_id", "cnt_7d")


@query("flt_4_labelled_only", with_ev(
    "SELECT event_id, target FROM ev JOIN lab USING (event_id)", LAB))
def _(t):
    return periods.labelled(periods.attach_by_event(t.log(), t.labels())).select("event_id", "target")


@query("flt_5_scored_after_windows", with_ev("""
SELECT event_id, cnt_7d FROM (SELECT event_id, period, COUNT(*) OVER (PARTITION BY customer_id ORDER BY us
  RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS cnt_7d FROM lg) WHERE period = 'test'""",
                                             LAB, PER))
def _(t):
    return _week_counts(t.period_log()).where("period = 'test'").select("event_id", "cnt_7d")


@query("flt_6_train_sample_or_test", with_ev("""
SELECT event_id, period FROM smp WHERE is_train_sample OR is_test""", LAB, PER, SAMPLED))
def _(t):
    return sampled(t).where("is_train_sample OR is_test").select("event_id", "period")


@query("flt_7_class_partition", with_ev("""
SELECT event_id, amt FROM ev JOIN lab USING (event_id) WHERE target = 1""", LAB))
def _(t):
    return periods.attach_by_event(t.log(), t.labels()).where("target = 1").select("event_id", "amt")


@query("flt_8_split_masks", with_ev(f"""
SELECT event_id, CASE WHEN period = 'train' AND target IS NOT NULL AND ts < TIMESTAMP '{HOLDOUT_START}' THEN 'train'
  WHEN period = 'train' AND target IS NOT NULL THEN 'val' WHEN period = 'test' THEN 'test' END AS split
FROM lg""", LAB, PER))
def _(t):
    return t.period_log().select("event_id", splits.split_name(HOLDOUT_START, split="period").alias("split"))


# --- samples ------------------------------------------------------------------------

HASH = md5_number("event_id")


@query("smp_1_positives_plus_share", with_ev(f"""
SELECT event_id, COALESCE(target, 0) AS target FROM ev LEFT JOIN lab USING (event_id)
WHERE target = 1 OR {HASH} % 100 < 10""", LAB))
def _(t):
    df = t.log().join(t.labels(), "event_id", "left").withColumn("target", rules.unlabelled_as_negative())
    return sampling.keep_positives(df, 10, hasher=portable_bucket).select("event_id", "target")


@query("smp_2_rotating_negatives", with_ev(f"""
SELECT event_id, cnt_7d FROM (
  SELECT event_id, COUNT(*) OVER (PARTITION BY customer_id ORDER BY us
    RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS cnt_7d
  FROM ev LEFT JOIN lab USING (event_id)
  WHERE target = 1 OR ({HASH} % 100 + 26) % 100 < 5)""", LAB))
def _(t):
    """Third fold (offset 2 * 13), sampled before the windows."""
    df = t.log().join(t.labels(), "event_id", "left").withColumn("target", rules.unlabelled_as_negative())
    kept = sampling.keep_positives(df, fv.ROTATION_KEEP_PERCENT, offset=2 * fv.ROTATION_STEP,
                                   hasher=portable_bucket)
    return _week_counts(kept).select("event_id", "cnt_7d")


@query("smp_3_customer_sample", with_ev(f"""
SELECT event_id, customer_id FROM ev WHERE {md5_number('customer_id')} % 20 = 0"""))
def _(t):
    return sampling.keep_customer_sample(t.log(), hasher=portable_bucket).select("event_id", "customer_id")


@query("smp_4_era_dependent", with_ev("SELECT event_id FROM smp WHERE is_train_sample", LAB, PER, SAMPLED))
def _(t):
    return sampled(t).where("is_train_sample").select("event_id")


@query("smp_5_exact_sample", with_ev(f"""
SELECT event_id FROM ev ORDER BY {md5_number('event_id', "'42'")}, event_id LIMIT 2000"""))
def _(t):
    """A hash orders the rows, so the same ones come out everywhere."""
    return sampling.exact_sample(t.log(), 2000).select("event_id")


@query("smp_1_native_hash")
def _(t):
    """The same sample with the faster 64-bit hash."""
    df = t.log().join(t.labels(), "event_id", "left").withColumn("target", rules.unlabelled_as_negative())
    return sampling.keep_positives(df, 10, hasher=bucket).select("event_id", "target")
