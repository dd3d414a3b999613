"""Joins."""

from pyspark.sql import functions as F

from ..operators import periods, predictions, priors
from ..operators.lineage import materialise
from ..operators.skew import DEFAULT_POLICY, SkewPolicy
from .inputs import REDUCED, prediction_files
from .registry import LAB, PER, SCO, query, with_ev


@query("jn_1_labels", with_ev("SELECT event_id, target FROM ev LEFT JOIN lab USING (event_id)", LAB))
def _(t):
    return periods.attach_labels(t.log(), t.labels()).select("event_id", "target")


@query("jn_1_sparse_quality_labels", """
SELECT doc_id AS event_id, CAST(toxic AS BIGINT) AS target, n_chars FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    docs = t.table("documents").select(F.col("doc_id").alias("event_id"), "n_chars")
    labels = t.table("labels").select(F.col("doc_id").alias("event_id"), F.col("toxic").alias("target"))
    return periods.attach_by_event(docs, labels).select("event_id", "target", "n_chars")


@query("jn_2_customers_with_history", with_ev(REDUCED, LAB, PER))
def _(t):
    return periods.tagged_union(t.periods()).select("event_id", "period")


@query("jn_3_history_of_scored_customers", with_ev("""
SELECT event_id, customer_id FROM lg WHERE period <> 'test'
  AND customer_id IN (SELECT customer_id FROM lg WHERE period = 'test')""", LAB, PER))
def _(t):
    df = t.period_log()
    scored = periods.customers_of(df.where("period = 'test'"))
    return periods.keep_customers(df.where("period <> 'test'"), scored).select("event_id", "customer_id")


@query("jn_4_event_reduction", with_ev("""
SELECT event_id, event_type FROM ev WHERE event_id IN (SELECT event_id FROM lab)""", LAB))
def _(t):
    return periods.keep_ids(t.table("events"), t.labels()).select("event_id", "event_type")


@query("jn_5_late_columns", with_ev("""
SELECT event_id, target, event_type, props FROM lab JOIN events USING (event_id)""", LAB))
def _(t):
    """Wide columns join the reduced rows at the end; shared columns stay single."""
    rows = t.labels()
    wide = periods.keep_ids(t.table("events").select("event_id", "event_type", "props"), rows)
    return periods.attach_by_event(rows, wide)


@query("jn_6_labelled_inner", with_ev("""
SELECT event_type, COUNT(*) AS lbl, CAST(SUM(target) AS BIGINT) AS red FROM ev JOIN lab USING (event_id)
GROUP BY event_type""", LAB))
def _(t):
    df = periods.attach_by_event(t.log(), t.labels(), "inner")
    return df.groupBy(F.col("mcc_code").alias("event_type")).agg(
        F.count("target").alias("lbl"), F.sum("target").alias("red"))


@query("jn_7_totals_with_labelled", with_ev("""
SELECT k, COUNT(*) AS cnt, COUNT(target) AS lbl, CAST(COALESCE(SUM(target), 0) AS BIGINT) AS red
FROM ev LEFT JOIN lab USING (event_id) GROUP BY k""", LAB))
def _(t):
    """Totals and labelled totals need one grouping after the label join, not two and a join."""
    df = periods.attach_by_event(t.log(), t.labels())
    return df.groupBy(F.col("event_desc").alias("k")).agg(
        F.count(F.lit(1)).alias("cnt"), F.count("target").alias("lbl"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("red"))


PRIOR_CTE = """pri_{c} AS (
  SELECT {c}, COUNT(*) AS cnt, (COALESCE(SUM(target), 0) + 1.0::DOUBLE) / (COUNT(*) + 200.0::DOUBLE) AS red_rate,
         (COUNT(target) + 1.0::DOUBLE) / (COUNT(*) + 200.0::DOUBLE) AS lbl_rate,
         (COALESCE(SUM(target), 0) + 1.0::DOUBLE) / (COUNT(target) + 2.0::DOUBLE) AS red_share
  FROM lg WHERE period = 'train' GROUP BY {c})"""


PRIORS_SQL = with_ev("""
SELECT event_id, a.cnt AS prior_mcc_code_cnt, a.red_rate AS prior_mcc_code_red_rate_all,
       b.lbl_rate AS prior_event_desc_labeled_rate_all, b.red_share AS prior_event_desc_red_share_labeled
FROM lg LEFT JOIN pri_event_type a USING (event_type) LEFT JOIN pri_k b USING (k)""",
                     LAB, PER, PRIOR_CTE.format(c="event_type"), PRIOR_CTE.format(c="k"))


def prior_features(t, policy):
    df = t.period_log()
    tables = priors.fit(priors.fit_rows(df), None, ["mcc_code", "event_desc"])
    return priors.apply(df, tables, policy).select(
        "event_id", "prior_mcc_code_cnt", "prior_mcc_code_red_rate_all",
        "prior_event_desc_labeled_rate_all", "prior_event_desc_red_share_labeled")


@query("jn_8_apply_priors", PRIORS_SQL)
def _(t):
    return prior_features(t, DEFAULT_POLICY)


@query("jn_8_apply_priors_salted", PRIORS_SQL)
def _(t):
    """Limits so low that the tables are shuffled and every merchant code is salted."""
    return prior_features(t, SkewPolicy(hot_rows=100, broadcast_rows=2))


@query("jn_9_merge_predictions", with_ev("SELECT event_id, p1 AS pred_a, p2 AS pred_b, p3 AS pred_c FROM sco", LAB, SCO))
def _(t):
    return predictions.merge_predictions(prediction_files(t))


@query("jn_10_suffixed_collision", with_ev("SELECT event_id, p1 AS predict, p2 AS predict_new FROM sco", LAB, SCO))
def _(t):
    files = prediction_files(t)
    return predictions.join_suffixed(files["a"], files["b"])


@query("jn_11_template_join", with_ev("""
SELECT lg.event_id, sco.p1 AS predict FROM lg LEFT JOIN sco ON lg.event_id = sco.event_id AND sco.p2 > 0.2
WHERE period = 'test'""", LAB, PER, SCO))
def _(t):
    template = t.period_log().where("period = 'test'").select("event_id")
    known = t.scores().where("p2 > 0.2").select("event_id", F.col("p1").alias("predict"))
    return predictions.fill_template(template, known)


@query("jn_12_missing_predictions", with_ev("""
SELECT lg.event_id FROM lg JOIN sco USING (event_id) WHERE period = 'test' AND NOT p2 > 0.2""", LAB, PER, SCO))
def _(t):
    template = t.period_log().where("period = 'test'").select("event_id")
    known = t.scores().where("p2 > 0.2").select("event_id", F.col("p1").alias("predict"))
    return predictions.missing_predictions(template, known)


@query("jn_13_align_scores", with_ev("""
SELECT event_id, ROUND(CASE WHEN p2 > 0.3 THEN p1 ELSE (SELECT AVG(p1) FROM sco WHERE p2 > 0.3) END, 9) AS p1
FROM sco""", LAB, SCO))
def _(t):
    s = t.scores()
    subset = materialise(s.where("p2 > 0.3").select("event_id", "p1"))
    return predictions.align_scores(s.select("event_id"), subset, "p1").select(
        "event_id", F.round("p1", 9).alias("p1"))
