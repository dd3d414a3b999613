"""Aggregations, correlations and distributions."""

from pyspark.sql import functions as F

from ..operators import compare, impute, normalise, periods, predictions, priors, profile, sampling, splits
from ..operators.lineage import materialise
from .inputs import DISAGREEMENT, prediction_files
from .joins import PRIOR_CTE
from .registry import HOLDOUT_START, LAB, PER, SCO, query, with_ev


@query("agg_1_rows_per_key", with_ev("SELECT k, COUNT(*) AS cnt FROM ev GROUP BY k"))
def _(t):
    return t.log().groupBy(F.col("event_desc").alias("k")).agg(F.count(F.lit(1)).alias("cnt"))


@query("agg_2_labelled_per_key", with_ev("""
SELECT k, COUNT(target) AS lbl_cnt, CAST(SUM(target) AS DOUBLE) AS red_cnt
FROM ev LEFT JOIN lab USING (event_id) GROUP BY k""", LAB))
def _(t):
    return periods.attach_by_event(t.log(), t.labels()).groupBy(F.col("event_desc").alias("k")).agg(
        F.count("target").alias("lbl_cnt"), F.sum("target").cast("double").alias("red_cnt"))


def prior_query(name, key, column):
    @query(name, with_ev(f"""
SELECT {column} AS {key}, cnt AS prior_{key}_cnt, red_rate AS prior_{key}_red_rate_all,
       lbl_rate AS prior_{key}_labeled_rate_all, red_share AS prior_{key}_red_share_labeled
FROM pri_{column}""", LAB, PER, PRIOR_CTE.format(c=column)))
    def _(t):
        """All keys are counted in one pass; this is one of the tables."""
        keys = ["mcc_code", "event_desc", "channel_indicator_sub_type"]
        return priors.fit(priors.fit_rows(t.period_log()), None, keys)[key]


prior_query("agg_3_priors_mcc_code", "mcc_code", "event_type")
prior_query("agg_3_priors_event_desc", "event_desc", "k")
prior_query("agg_3_priors_sub_type", "channel_indicator_sub_type", "sub")


@query("agg_3_priors_leak_free", with_ev(f"""
SELECT event_type AS mcc_code, COUNT(*) AS prior_mcc_code_cnt,
  (COALESCE(SUM(target), 0) + 1.0::DOUBLE) / (COUNT(*) + 200.0::DOUBLE) AS prior_mcc_code_red_rate_all,
  (COUNT(target) + 1.0::DOUBLE) / (COUNT(*) + 200.0::DOUBLE) AS prior_mcc_code_labeled_rate_all,
  (COALESCE(SUM(target), 0) + 1.0::DOUBLE) / (COUNT(target) + 2.0::DOUBLE) AS prior_mcc_code_red_share_labeled
FROM lg WHERE period = 'train' AND ts < TIMESTAMP '{HOLDOUT_START}' GROUP BY event_type""", LAB, PER))
def _(t):
    return priors.fit(priors.fit_rows(t.period_log(), HOLDOUT_START), None, ["mcc_code"])["mcc_code"]


@query("agg_4_label_counts", with_ev("SELECT target, COUNT(*) AS n FROM lab GROUP BY target", LAB))
def _(t):
    return t.labels().groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("agg_5_distinct_customers", with_ev("SELECT DISTINCT customer_id FROM ev"))
def _(t):
    return periods.customers_of(t.log())


@query("agg_6_keep_first", """
SELECT user_id AS customer_id, event_id, value AS amt FROM events
QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def _(t):
    df = t.log().select("customer_id", "event_us", "event_id", "amt")
    return predictions.keep_first(df, "customer_id", ["event_us", "event_id"]).drop("event_us")


@query("agg_7_correlation", with_ev("SELECT ROUND(corr(p1, p2), 9) AS corr FROM sco", LAB, SCO))
def _(t):
    pair = predictions.join_suffixed(*list(prediction_files(t).values())[:2])
    return compare.correlation(pair, "predict", "predict_new").select(F.round("corr", 9).alias("corr"))


def corr_sql(columns, source):
    cells = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, ROUND(corr({a}, {b}), 9) AS corr FROM {source}"
             for a in columns for b in columns]
    return "\nUNION ALL ".join(cells)


@query("agg_8_score_correlations", with_ev(
    corr_sql(["pred_a", "pred_b", "pred_c"], "m"), LAB, SCO,
    "m AS (SELECT p1 AS pred_a, p2 AS pred_b, p3 AS pred_c FROM sco)"))
def _(t):
    merged = predictions.merge_predictions(prediction_files(t))
    matrix = compare.correlation_matrix(merged, ["pred_a", "pred_b", "pred_c"])
    return matrix.withColumn("corr", F.round("corr", 9))


LINE = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "target"]


@query("agg_9_numeric_correlations", "WITH m AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 "
       "WHEN l_linestatus = 'O' THEN 0 END AS target FROM lineitem)\n" + corr_sql(LINE, "m"))
def _(t):
    """All numeric columns and a target that is null on some rows."""
    df = t.table("lineitem").withColumn(
        "target", F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_linestatus") == "O", 0))
    columns = normalise.numeric_columns(df, ("l_orderkey", "l_partkey", "l_suppkey"))
    return compare.correlation_matrix(df, columns).withColumn("corr", F.round("corr", 9))


@query("agg_10_class_and_split_counts", with_ev("""
SELECT period, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE target = 1) AS n_pos,
       COUNT(*) FILTER (WHERE target = 0) AS n_neg FROM lg GROUP BY period""", LAB, PER))
def _(t):
    return splits.class_counts(t.period_log(), by=["period"])


@query("agg_11_class_weight", with_ev("""
SELECT CASE WHEN SUM(label) > 0 THEN 0.5::DOUBLE * (COUNT(*) - SUM(label)) / SUM(label) ELSE 1.0::DOUBLE END AS pos_weight
FROM sco""", LAB, SCO))
def _(t):
    return splits.positive_weight(t.scores(), "label")


@query("agg_12_latest_event", with_ev("SELECT MAX(us) AS latest FROM ev"))
def _(t):
    return t.log().agg(F.max("event_us").alias("latest"))


@query("agg_13_mean_median", with_ev("""
SELECT event_id, ROUND(COALESCE(x, (SELECT AVG(x) FROM n)), 6) AS by_mean,
       ROUND(COALESCE(x, (SELECT MEDIAN(x) FROM n)), 6) AS by_median FROM n""",
                                     "n AS (SELECT event_id, CASE WHEN k < 90 THEN amt END AS x FROM ev)"))
def _(t):
    x = F.when(F.col("event_desc") < 90, F.col("amt"))
    df = t.log().select("event_id", x.alias("by_mean"), x.alias("by_median"))
    df = impute.fill_medians(impute.fill_means(df, ["by_mean"]), ["by_median"], df)
    return df.select("event_id", F.round("by_mean", 6).alias("by_mean"),
                     F.round("by_median", 6).alias("by_median"))


HIST = """
SELECT r.col AS "column", b.bin AS bin, r.lo + b.bin * ((r.hi - r.lo) / 50) AS low,
       r.lo + (b.bin + 1) * ((r.hi - r.lo) / 50) AS high, COUNT(v.x) AS n
FROM (SELECT col, MIN(x) AS lo, MAX(x) AS hi FROM v GROUP BY col) r
CROSS JOIN (SELECT range AS bin FROM range(50)) b
LEFT JOIN v ON v.col = r.col AND b.bin = LEAST(CAST(FLOOR((v.x - r.lo) / ((r.hi - r.lo) / 50)) AS BIGINT), 49)
GROUP BY 1, 2, 3, 4"""


@query("agg_14_histograms", with_ev(HIST, LAB, SCO, f"d AS ({DISAGREEMENT})",
       "v AS (SELECT 'mean_pred' AS col, mean_pred AS x FROM d UNION ALL SELECT 'std_pred', std_pred FROM d)"))
def _(t):
    table = materialise(compare.disagreement(predictions.merge_predictions(prediction_files(t))))
    return profile.histogram(table, ["mean_pred", "std_pred"])


@query("agg_15_class_density", with_ev("""
SELECT b.col AS feature, b.col = 'amt' AS log_axis, b.target, b.bin, b.n,
       ROUND(b.n / SUM(b.n) OVER (PARTITION BY b.col, b.target) / b.width, 9) AS density
FROM (SELECT v.col, v.target, (r.hi - r.lo) / 20 AS width,
             LEAST(CAST(FLOOR((v.x - r.lo) / ((r.hi - r.lo) / 20)) AS BIGINT), 19) AS bin, COUNT(*) AS n
      FROM v JOIN (SELECT col, MIN(x) AS lo, MAX(x) AS hi FROM v GROUP BY col) r ON v.col = r.col
      GROUP BY ALL) b""", LAB, SCO, """v AS (
  SELECT 'amt' AS col, target, log10(amt) AS x FROM ev JOIN lab USING (event_id) WHERE amt > 0
  UNION ALL SELECT 'hour', target, CAST(hour(ts) AS DOUBLE) FROM ev JOIN lab USING (event_id))"""))
def _(t):
    df = materialise(periods.attach_by_event(t.log(), t.labels(), "inner").select(
        "amt", F.hour("event_ts").alias("hour"), "target"))
    out = profile.class_density(df, {"amt": True, "hour": False}, bins=20)
    return out.withColumn("density", F.round("density", 9))


@query("agg_15_contrast_sample", with_ev("SELECT event_id, target FROM lab", LAB))
def _(t):
    """All positives and at most 50,000 negatives; at this scale every negative fits."""
    return sampling.contrast_sample(t.labels())
