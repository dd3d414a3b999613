"""Splits, weights, training, blending and evaluation."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as rules
from ..functions.probability import logit_product
from ..functions.rowwise import row_mean
from ..models import boosting, bundle, stacking
from ..models.encode import Encoder
from ..operators import evaluate, predictions, splits, staged
from ..operators.lineage import materialise
from ..plans.velocity import velocity
from ..sources import sinks
from .registry import HOLDOUT_START, LAB, PER, RECENT_BORDER, SCO, md5_number, query, with_ev
from .scalars import LOGIT, SIGMOID, clip_sql

SMALL = boosting.Boosting(iterations=20, step=0.3, depth=3)


@query("ml_1_fixed_holdout", with_ev(f"""
SELECT event_id, CAST(ts >= TIMESTAMP '{HOLDOUT_START}' AS BIGINT) AS is_val FROM ev"""))
def _(t):
    return t.log().select("event_id", splits.fixed_holdout(HOLDOUT_START).cast("int").alias("is_val"))


@query("ml_2_relative_holdout", with_ev("""
SELECT event_id, CAST(us >= (SELECT MAX(us) FROM ev) - 7 * 86400000000 AS BIGINT) AS is_val FROM ev"""))
def _(t):
    return splits.mark_holdout(t.log(), days=7).select("event_id", F.col("is_val").cast("int").alias("is_val"))


@query("ml_3_position_fallback", with_ev("""
SELECT event_id, CAST(ROW_NUMBER() OVER (ORDER BY us, event_id)
  > GREATEST(1, FLOOR(0.8 * (SELECT COUNT(*) FROM ev))) AS BIGINT) AS is_val FROM ev"""))
def _(t):
    """The last 400 days cover everything, so the split falls back to 80/20 by position."""
    return splits.mark_holdout(t.log(), days=400).select("event_id", F.col("is_val").cast("int").alias("is_val"))


@query("ml_4_row_weights", with_ev("""
SELECT event_id, CASE raw WHEN 1 THEN 10.0::DOUBLE WHEN 0 THEN 2.5 ELSE 1.0 END AS w_main,
       CASE WHEN raw <> -1 THEN 6.0::DOUBLE ELSE 1.2 END AS w_suspicious,
       CASE WHEN raw = 1 THEN 2.2::DOUBLE ELSE 1.0 END AS w_red_yellow
FROM lg WHERE raw IS NOT NULL""", LAB, PER))
def _(t):
    return t.period_log().where("train_target_raw IS NOT NULL").select(
        "event_id", rules.main_weight().alias("w_main"), rules.suspicious_weight().alias("w_suspicious"),
        rules.red_yellow_weight().alias("w_red_yellow"))


@query("ml_5_positive_weight", with_ev("""
SELECT event_id, CASE WHEN label = 1 THEN (SELECT 0.5::DOUBLE * (COUNT(*) - SUM(label)) / SUM(label) FROM sco)
  ELSE 1.0::DOUBLE END AS weight FROM sco""", LAB, SCO))
def _(t):
    s = t.scores()
    weight = splits.positive_weight(s, "label").first()["pos_weight"]
    return boosting.weigh_positives(s, weight).select("event_id", "weight")


@query("ml_10_recent_subset", with_ev(f"""
SELECT event_id FROM lg WHERE period = 'train' AND (ts >= TIMESTAMP '{RECENT_BORDER}' OR raw <> -1)""", LAB, PER))
def _(t):
    df = t.period_log().where("period = 'train'")
    return df.where(splits.recent_subset(RECENT_BORDER)).select("event_id")


@query("ml_11_derived_targets", with_ev("""
SELECT event_id, CAST(raw <> -1 AS BIGINT) AS suspicious,
       CASE WHEN raw <> -1 THEN CAST(raw = 1 AS BIGINT) END AS red_vs_yellow
FROM lg WHERE period = 'train'""", LAB, PER))
def _(t):
    raw = F.col("train_target_raw")
    return t.period_log().where("period = 'train'").select(
        "event_id", rules.suspicious().alias("suspicious"),
        F.when(raw != -1, (raw == 1).cast("int")).alias("red_vs_yellow"))


def ap_sql(source, score, by=""):
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
SELECT {keys}ROUND(SUM(tp * ctp::DOUBLE / cn) / SUM(tp), 9) AS ap, CAST(SUM(tp) AS BIGINT) AS n_pos,
       CAST(SUM(n) AS BIGINT) AS n_rows
FROM (SELECT {keys}tp, n, SUM(tp) OVER w AS ctp, SUM(n) OVER w AS cn
      FROM (SELECT {keys}{score} AS score, SUM(label) AS tp, COUNT(*) AS n FROM {source} GROUP BY ALL)
      WINDOW w AS ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
{'GROUP BY ' + by if by else ''}"""


@query("ml_12_average_precision", with_ev(ap_sql("sco", "p1"), LAB, SCO))
def _(t):
    return evaluate.average_precision(t.scores(), "p1").withColumn("ap", F.round("ap", 9))


@query("ml_12_average_precision_ties", with_ev(ap_sql("sco", "p3"), LAB, SCO))
def _(t):
    """24 distinct scores over all rows."""
    return evaluate.average_precision(t.scores(), "p3").withColumn("ap", F.round("ap", 9))


@query("ml_12_average_precision_ranges", with_ev(ap_sql("sco", "p1"), LAB, SCO))
def _(t):
    """The same figure with the scores cut into many ranges."""
    out = evaluate.average_precision(t.scores(), "p1", range_rows=500)
    return out.withColumn("ap", F.round("ap", 9))


GRID = """grid AS (
  SELECT m / 20.0::DOUBLE AS w_main, r / 20.0::DOUBLE AS w_recent, (20 - m - r) / 20.0::DOUBLE AS w_product
  FROM (SELECT range AS m FROM range(6, 19)), (SELECT range AS r FROM range(0, 9)) WHERE 20 - m - r >= 0),
bl AS (SELECT w_main, w_recent, w_product, label, w_main * p1 + w_recent * p2 + w_product * p3 AS score
  FROM grid, sco)"""


def blend_search(t):
    return evaluate.blend_search(t.scores(), main="p1", recent="p2", product="p3")


@query("ml_13_blend_search", with_ev(
    "SELECT w_main, w_recent, w_product, ap FROM (" + ap_sql("bl", "score", "w_main, w_recent, w_product") + ")",
    LAB, SCO, GRID))
def _(t):
    return blend_search(t).withColumn("ap", F.round("ap", 9))


@query("ml_13_best_blend", with_ev(
    "SELECT w_main, w_recent, w_product, ap FROM (" + ap_sql("bl", "score", "w_main, w_recent, w_product")
    + ") ORDER BY ap DESC, w_main, w_recent LIMIT 1", LAB, SCO, GRID))
def _(t):
    return evaluate.best_blend(blend_search(t)).withColumn("ap", F.round("ap", 9))


@query("ml_14_logit_product", with_ev(f"""
SELECT event_id, ROUND({LOGIT.format(p='q')}, 6) AS log_odds FROM (
  SELECT event_id, {clip_sql('(' + SIGMOID.format(x='(4 * p1 - 1)') + ') * (' + SIGMOID.format(x='(2 * p2)') + ')')} AS q
  FROM sco)""", LAB, SCO))
def _(t):
    return t.scores().select("event_id", F.round(
        logit_product(4 * F.col("p1") - 1, 2 * F.col("p2")), 6).alias("log_odds"))


@query("ml_15_fixed_blend", with_ev("SELECT event_id, 0.7::DOUBLE * p1 + 0.3::DOUBLE * p2 AS blend FROM sco", LAB, SCO))
def _(t):
    return t.scores().select("event_id", evaluate.fixed_blend("p1", "p2").alias("blend"))


@query("ml_15_holdout_report", with_ev(
    "SELECT kind AS score, ap, n_pos, n_rows FROM (" + ap_sql("stacked", "value", "kind") + ")", LAB, SCO, GRID, f"""
best AS (SELECT w_main, w_recent, w_product FROM ({ap_sql("bl", "score", "w_main, w_recent, w_product")})
  ORDER BY ap DESC, w_main, w_recent LIMIT 1),
aligned AS (SELECT AVG(p2) AS mean FROM sco WHERE ts >= TIMESTAMP '{RECENT_BORDER}'),
stacked AS (
  SELECT 'main' AS kind, p1 AS value, label FROM sco UNION ALL SELECT 'recent', p2, label FROM sco
  UNION ALL SELECT 'product', p3, label FROM sco UNION ALL SELECT 'fixed', 0.7::DOUBLE * p1 + 0.3::DOUBLE * p2, label FROM sco
  UNION ALL SELECT 'best', w_main * p1 + w_recent * p2 + w_product * p3, label FROM sco, best
  UNION ALL SELECT 'recent_aligned', CASE WHEN ts >= TIMESTAMP '{RECENT_BORDER}' THEN p2 ELSE mean END, label FROM sco, aligned)"""))
def _(t):
    """Every score of the holdout and its blends in one table; the aligned score knows the recent events only."""
    best = evaluate.best_blend(blend_search(t)).first()
    held = t.scores().withColumn("in_recent", F.col("event_ts") >= F.lit(RECENT_BORDER).cast("timestamp"))
    out = evaluate.holdout_report(held, {n: best[f"w_{n}"] for n in ("main", "recent", "product")}, "in_recent", "p1", "p2", "p3")
    return out.withColumn("ap", F.round("ap", 9))


@query("ml_8_seed_mean", with_ev("SELECT event_id, (p1 + p2 + p3) / 3 AS predict FROM sco", LAB, SCO))
def _(t):
    return t.scores().select("event_id", row_mean(["p1", "p2", "p3"]).alias("predict"))


@query("ml_18_submission", with_ev("""
SELECT event_id, MIN(predict) AS predict FROM (
  SELECT event_id, p1 AS predict FROM sco UNION ALL SELECT event_id, p2 FROM sco)
WHERE event_id IN (SELECT event_id FROM lg WHERE period = 'test') GROUP BY event_id""", LAB, PER, SCO))
def _(t):
    """Two scores per event, one kept; the template covers the test period."""
    files = prediction_pair(t)
    template = t.period_log().where("period = 'test'").select("event_id")
    return predictions.submission(files, template)


def prediction_pair(t):
    s = t.scores()
    return s.select("event_id", F.col("p1").alias("predict")).unionByName(
        s.select("event_id", F.col("p2").alias("predict")))


# --- trained models -----------------------------------------------------------------

def model_rows(t):
    """Velocity rows of labelled history with a vector of features: train and scored rows."""
    rows = velocity(t.period_log(), amount="amt").withColumn("label", rules.unlabelled_as_negative())
    numeric = ["amt", "hour", "day_of_week", "seconds_since_prev", "amt_24h", "cnt_24h", "avg_amt_7d",
               "unique_mcc_7d", "session_cnt", "ratio_amt_7d"]
    rows = materialise(rows)
    train = rows.where("period = 'train'").withColumn("is_val", splits.fixed_holdout(HOLDOUT_START))
    encoder = Encoder(["mcc_code", "customer_id"], numeric, indexed=["mcc_code"], hasher="portable_bucket").fit(train.where(~F.col("is_val")))
    keep = ["event_id", "label", "features"]
    train = materialise(boosting.weigh_positives(encoder.transform_training(train, ~F.col("is_val")), 5.0).select(
        *keep, "is_val", "weight"))
    return encoder, train, encoder.transform(rows.where("period = 'test'")).select(*keep)


@query("ml_6_boosted_holdout")
def _(t):
    _, train, test = model_rows(t)
    model, _ = boosting.fit_holdout(train, SMALL)
    return boosting.score(model, test).select("event_id", "predict")


MEMBERS = 8


@query("ml_6_staged_losses", with_ev(f"""
SELECT j AS iteration, ROUND(SUM(w * (GREATEST(z, 0) + LN(1 + EXP(-ABS(z))))) / SUM(w), 9) AS loss
FROM (SELECT j, CASE WHEN label = 1 THEN 5.0::DOUBLE ELSE 1.0 END AS w,
             (CASE WHEN label = 1 THEN -1 ELSE 1 END) * SUM((p1 - 0.2) / j + (p2 - 0.5) / (j + 1) - 0.3) OVER (
               PARTITION BY event_id ORDER BY j) AS z
      FROM sco, (SELECT range AS j FROM range(1, {MEMBERS + 1})))
GROUP BY j""", LAB, SCO))
def _(t):
    """The loss of each prefix of eight additive members over all events."""
    s = t.scores()
    parts = F.array(*[(F.col("p1") - 0.2) / j + (F.col("p2") - 0.5) / (j + 1) - 0.3 for j in range(1, MEMBERS + 1)])
    rows = boosting.weigh_positives(s.withColumn("parts", parts), 5.0)
    return staged.staged_losses(rows, "parts").withColumn("loss", F.round("loss", 9))


@query("ml_6_patience", with_ev("""
SELECT event_type, CAST(MAX(best_at) AS BIGINT) AS best_iteration, CAST(MIN(loss) AS DOUBLE) AS best_loss,
       CAST(MAX(stop) AS BIGINT) AS stopped_at
FROM cut WHERE stop IS NULL OR iteration <= stop GROUP BY event_type""", """curve AS (
  SELECT event_type, DENSE_RANK() OVER (PARTITION BY event_type ORDER BY day) AS iteration, loss
  FROM (SELECT event_type, us // 86400000000 AS day, SUM(units) // 10000 // COUNT(*) AS loss FROM ev GROUP BY ALL)),
read AS (
  SELECT *, MAX(CASE WHEN fresh THEN iteration END) OVER w AS best_at
  FROM (SELECT *, COALESCE(loss < MIN(loss) OVER (PARTITION BY event_type ORDER BY iteration
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS fresh FROM curve)
  WINDOW w AS (PARTITION BY event_type ORDER BY iteration)),
cut AS (SELECT *, MIN(CASE WHEN iteration - best_at >= 3 THEN iteration END) OVER (PARTITION BY event_type) AS stop FROM read)"""))
def _(t):
    """The mean amount of each day, a curve per event type, read until three days bring nothing lower."""
    e = t.log().withColumn("units", F.round(F.col("amt") * 10000).cast("bigint"))
    days = e.groupBy(F.col("event_type_nm").alias("event_type"), "session_id").agg(
        F.expr("sum(units) div 10000 div count(*)").cast("double").alias("loss"))
    place = F.dense_rank().over(Window.partitionBy("event_type").orderBy("session_id"))
    return staged.stopping_point(days.withColumn("iteration", place), wait=3, by=["event_type"])


FITTED = f"""fitted AS (SELECT *, {md5_number('event_id')} % 32 AS bucket, COALESCE(target, 0) AS hit
  FROM lg WHERE period = 'train' AND ts < TIMESTAMP '{HOLDOUT_START}'),
running AS (
  SELECT event_id, (COALESCE(SUM(hit) OVER w, 0) + 1.0::DOUBLE) / (COUNT(*) OVER w + 200.0::DOUBLE) AS rate
  FROM fitted WINDOW w AS (PARTITION BY customer_id ORDER BY bucket RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
whole AS (SELECT customer_id, (SUM(hit) + 1.0::DOUBLE) / (COUNT(*) + 200.0::DOUBLE) AS rate FROM fitted GROUP BY ALL),
places AS (SELECT event_type, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, event_type) - 1 AS DOUBLE) AS place
  FROM fitted GROUP BY event_type)"""


@query("ml_7_encoded_features", with_ev("""
SELECT lg.event_id, COALESCE(place, (SELECT COUNT(*) FROM places)) AS mcc_index, amt,
       COALESCE(running.rate, whole.rate, (SELECT MEDIAN(rate) FROM running)) AS rate_customer
FROM lg LEFT JOIN places USING (event_type) LEFT JOIN running ON running.event_id = lg.event_id
     LEFT JOIN whole ON whole.customer_id = lg.customer_id
WHERE period = 'train'""", LAB, PER, FITTED))
def _(t):
    """Of the feature vector: the index, the first number, and the customer's rate; holdout rows get the full rate."""
    _, train, _ = model_rows(t)
    v = vector_to_array("features")
    return train.select("event_id", v[0].alias("mcc_index"), v[1].alias("amt"), F.element_at(v, -1).alias("rate_customer"))


@query("ml_8_seed_bagging")
def _(t):
    _, train, test = model_rows(t)
    models = boosting.fit_bag(train, SMALL, seeds=(42, 777))
    return boosting.score_bag(models, test, keep_members=True).drop("features", "label")


@query("ml_9_stacking")
def _(t):
    _, train, test = model_rows(t)
    models, meta, _ = stacking.fit_stack(lambda i: train, SMALL, (42, 777), trees=5)
    return stacking.score_stack(models, meta, test).select("event_id", "boosted", "forest", "predict")


@query("ml_16_refit_all_rows")
def _(t):
    _, train, test = model_rows(t)
    _, best = boosting.fit_holdout(train, SMALL)
    model = boosting.refit(train, SMALL, best, least=6)
    return boosting.score(model, test).select("event_id", "predict")


@query("ml_17_log_odds_scoring")
def _(t):
    _, train, test = model_rows(t)
    model, _ = boosting.fit_holdout(train, SMALL)
    return boosting.log_odds(model, test).select("event_id", "predict")


def all_of(*rules):
    """1 where all hold."""
    found = rules[0]
    for rule in rules[1:]:
        found = found & rule
    return F.coalesce(found.cast("int"), F.lit(0))


TEST_ROWS = "SELECT event_id, 1::BIGINT AS {0} FROM lg WHERE period = 'test'"


@query("ml_9_stack_rules", with_ev(TEST_ROWS.format("holds"), LAB, PER))
def _(t):
    """Every scored event once, with the meta-model's probability over the mean of each learner."""
    _, train, test = model_rows(t)
    models, meta, _ = stacking.fit_stack(lambda i: train, SMALL, (42, 777), trees=5)
    out = stacking.score_stack(models, meta, test)
    b, f = meta.coefficients
    z = b * F.col("boosted") + f * F.col("forest") + meta.intercept
    return out.select("event_id", all_of(F.col("predict").between(0, 1), F.abs(F.col("predict") - 1 / (1 + F.exp(-z))) < 1e-9).alias("holds"))


@query("ml_16_refit_rules", with_ev("""
SELECT 1::BIGINT AS kept_is_best, 1::BIGINT AS refit_size, CAST(COUNT(*) AS BIGINT) AS in_range
FROM lg WHERE period = 'test'""", LAB, PER))
def _(t):
    """The kept prefix has the least holdout loss, and the refit as many trees, at least six and at most the limit."""
    _, train, test = model_rows(t)
    model, best = boosting.fit_holdout(train, SMALL)
    longest = boosting.fit_holdout(train.withColumn("is_val", F.lit(False)), SMALL)[0]      # without a holdout: all
    refitted = boosting.refit(train, SMALL, best, least=6)
    held = train.where("is_val").withColumn("label", F.col("label").cast("double"))
    loss = boosting.holdout_losses(model, held)
    scored = boosting.score(refitted, test)
    return scored.agg(F.lit(int(len(loss) == best and min(loss) == loss[-1] and longest.getNumTrees == SMALL.iterations)).alias("kept_is_best"),
                      F.lit(int(refitted.getNumTrees == min(SMALL.iterations, max(6, best)))).alias("refit_size"),
                      F.count_if(F.col("predict").between(0, 1)).alias("in_range"))


@query("ml_17_odds_rules", with_ev(TEST_ROWS.format("holds"), LAB, PER))
def _(t):
    """Log-odds give the probabilities back, and a bag's probability is its members' mean."""
    _, train, test = model_rows(t)
    models = boosting.fit_bag(train, SMALL, seeds=(42, 777))
    out = boosting.log_odds(models[0], boosting.score_bag(models, test, keep_members=True), "z")
    back, mean = 1 / (1 + F.exp(-F.col("z"))), (F.col("predict_0") + F.col("predict_1")) / 2
    return out.select("event_id", all_of(F.abs(back - F.col("predict_0")) < 1e-9, F.abs(mean - F.col("predict")) < 1e-12,
                                         F.col("predict").between(0, 1)).alias("holds"))


@query("snk_4_model_round_trip", with_ev("""
SELECT event_id, 0.0::DOUBLE AS difference, 1::BIGINT AS in_range FROM lg WHERE period = 'test'""", LAB, PER))
def _(t):
    """A bundle of encoder and bag is stored and read back; both score the raw feature rows."""
    encoder, train, _ = model_rows(t)
    models = boosting.fit_bag(train, SMALL, seeds=(42, 777))
    fitted = bundle.bundle(encoder, bundle.EnsembleModel("mean", {f"seed_{i}": m for i, m in enumerate(models)}))
    path = t.scratch()
    sinks.save_model(fitted, path)
    rows = velocity(t.period_log(), amount="amt").where("period = 'test'")
    before = fitted.transform(rows).select("event_id", F.col("predict").alias("before"))
    after = bundle.load(path).transform(rows).select("event_id", "predict")
    return before.join(after, "event_id").select(
        "event_id", (F.col("before") - F.col("predict")).alias("difference"), all_of(F.col("predict").between(0, 1)).alias("in_range"))
