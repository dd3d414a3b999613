"""Sources, sinks, set operations, sorts and limits."""

from uuid import uuid4

from pyspark.sql import functions as F

from ..models.stacking import stack_holdout
from ..functions.calendar import DAY_US
from ..operators import compare, normalise, periods
from ..operators.history import HistoryColumns, history_features
from ..operators.lineage import ensure_checkpoint_dir
from ..operators.predictions import merge_predictions
from ..sources import readers, sinks
from ..sources.schemas import SchemaRegistry
from .registry import LAB, PER, SCO, query, with_ev

EVENT_ROWS = "SELECT event_id, user_id AS customer_id, value AS amt FROM events"


def _event_rows(df):
    return df.select("event_id", F.col("user_id").alias("customer_id"), F.col("value").alias("amt"))


@query("src_1_glob_scan", EVENT_ROWS)
def _(t):
    return _event_rows(readers.read_events(t.spark, readers.find_paths(t.spark, f"{t.base}/event*.parquet")))


@query("src_2_name_exclusion", EVENT_ROWS)
def _(t):
    """Both events and documents match the glob; the excluded name drops documents."""
    paths = readers.find_paths(t.spark, f"{t.base}/*nts.parquet", exclude="doc")
    return _event_rows(readers.read_events(t.spark, paths))


@query("src_3_fallback_location", EVENT_ROWS)
def _(t):
    paths = readers.resolve(t.spark, [f"{t.base}/absent_*.parquet", t.path("events")])
    return _event_rows(readers.read_events(t.spark, paths))


@query("src_4_schema_tolerant", """
SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(NULL AS BIGINT) AS n_chars FROM labels
UNION ALL SELECT doc_id, NULL, n_chars FROM documents""")
def _(t):
    df = readers.read_events(t.spark, [t.path("labels"), t.path("documents")], tolerant=True)
    return df.select("doc_id", "quality", "n_chars")


@query("src_4_schema_registry", """
SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(NULL AS BIGINT) AS n_chars, CAST(NULL AS VARCHAR) AS url FROM labels
UNION ALL SELECT doc_id, NULL, n_chars, NULL FROM documents
UNION ALL SELECT NULL, NULL, NULL, url FROM pages""")
def _(t):
    """Three drifting inputs; the second read opens no footer."""
    registry = SchemaRegistry(t.spark, f"{ensure_checkpoint_dir(t.spark)}/stored-{uuid4().hex}")
    paths = [t.path("labels"), t.path("documents"), t.path("pages")]
    registry.schema(paths[:1])
    registry.schema(paths)
    return registry.read(paths).select("doc_id", "quality", "n_chars", "url")


@query("src_5_conditional_column", with_ev("""
SELECT event_id, session_id, CAST(-1 AS BIGINT) AS device_id FROM ev"""))
def _(t):
    df = normalise.ensure_column(t.log(), "session_id", -1, "bigint")
    return normalise.ensure_column(df, "device_id", -1, "bigint").select(
        "event_id", "session_id", "device_id")


@query("src_6_first_files", "SELECT doc_id, lang, n_chars FROM documents")
def _(t):
    """The first of the two matching files in name order."""
    paths = readers.find_paths(t.spark, f"{t.base}/*nts.parquet")
    return readers.read_events(t.spark, paths, first_files=1).select("doc_id", "lang", "n_chars")


@query("src_7_first_rows", EVENT_ROWS + " ORDER BY event_id LIMIT 5000")
def _(t):
    return _event_rows(readers.first_rows(t.table("events"), 5000))


@query("src_8_csv_predictions", "SELECT event_id, value / 500.0::DOUBLE AS predict FROM events")
def _(t):
    path = t.scratch()
    sinks.write_predictions(t.scores().select("event_id", F.col("p1").alias("predict")), path)
    return readers.read_predictions(t.spark, path)


@query("src_9_existing_inputs", EVENT_ROWS)
def _(t):
    paths = readers.existing(t.spark, [t.path("absent"), t.path("events")], required=False)
    return _event_rows(readers.require_rows(readers.read_events(t.spark, paths), "event log"))


@query("src_10_label_table",
       "SELECT doc_id AS event_id, CAST(toxic AS BIGINT) AS target FROM labels")
def _(t):
    return readers.label_columns(t.table("labels").select(
        F.col("doc_id").alias("event_id"), F.col("toxic").alias("target")))


REDUCED = """
SELECT event_id, period FROM lg
WHERE period IN ('pretrain', 'train')
   OR customer_id IN (SELECT customer_id FROM lg WHERE period = 'pretrain')"""


@query("src_11_period_union", with_ev(REDUCED, LAB, PER))
def _(t):
    return periods.tagged_union(t.periods()).select("event_id", "period")


@query("snk_1_csv_write", "SELECT event_id, (value + 1) / 600.0::DOUBLE AS predict FROM events")
def _(t):
    path = t.scratch()
    sinks.write_predictions(
        t.table("events").select("event_id", ((F.col("value") + 1) / 600.0).alias("predict")), path)
    return readers.read_predictions(t.spark, path)


@query("snk_2_parquet_zstd", EVENT_ROWS)
def _(t):
    path = t.scratch()
    sinks.write_table(_event_rows(t.table("events")), path)
    return t.spark.read.parquet(path)


@query("snk_3_reuse_or_write", EVENT_ROWS)
def _(t):
    """The second call finds the stored table and does not build its own."""
    path = t.scratch()
    sinks.reuse_or_write(t.spark, path, lambda: _event_rows(t.table("events")))
    return sinks.reuse_or_write(t.spark, path, lambda: t.table("nation"))


# --- set operations -----------------------------------------------------------------

@query("set_1_strict_union", with_ev("""
SELECT event_id, CAST(CASE WHEN period = 'test' THEN 1 ELSE 0 END AS BIGINT) AS is_submit
FROM lg WHERE period IN ('pretest', 'test')""", LAB, PER))
def _(t):
    cut = t.periods()
    return periods.union_strict(
        periods.tag(cut["pretest"], is_submit=0), periods.tag(cut["test"], is_submit=1)
    ).select("event_id", "is_submit")


@query("set_2_widening_union", """
SELECT CAST(p_size AS BIGINT) AS size_or_key FROM part UNION ALL SELECT s_suppkey FROM supplier""")
def _(t):
    return periods.union_strict(
        t.table("part").select(F.col("p_size").alias("size_or_key")),
        t.table("supplier").select(F.col("s_suppkey").alias("size_or_key")))


@query("set_3_diagonal_union", with_ev("""
SELECT event_id, target, session_id FROM (
  SELECT event_id, target, CAST(NULL AS BIGINT) AS session_id FROM lg WHERE period = 'train'
  UNION ALL SELECT event_id, NULL, session_id FROM lg WHERE period <> 'train')""", LAB, PER))
def _(t):
    df = t.period_log()
    return periods.union_diagonal(
        df.where("period = 'train'").select("event_id", "target"),
        df.where("period <> 'train'").select("event_id", "session_id"))


@query("set_4_class_union", with_ev("SELECT event_id, target FROM lab", LAB))
def _(t):
    labels = t.labels()
    return periods.union_strict(labels.where("target = 1"), labels.where("target = 0"))


@query("set_5_stacked_holdout", with_ev("""
SELECT CAST(42 AS BIGINT) AS fold, label, p1 AS boosted, p2 AS forest FROM sco
UNION ALL SELECT 777, label, p2, p3 FROM sco""", LAB, SCO))
def _(t):
    s = t.scores()
    return stack_holdout([
        (42, s.select("label", F.col("p1").alias("boosted"), F.col("p2").alias("forest"))),
        (777, s.select("label", F.col("p2").alias("boosted"), F.col("p3").alias("forest")))])


# --- sorts and limits ---------------------------------------------------------------

@query("ord_2_deterministic_order", with_ev("""
SELECT event_id, customer_id,
  ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY us // 86400000000, event_id) AS position
FROM ev"""))
def _(t):
    """Rows of one day tie on time; the event id orders them."""
    day = t.log().withColumn("event_us", F.floor(F.col("event_us") / DAY_US))
    return history_features(day, HistoryColumns(mcc="mcc_code")).select(
        "event_id", "customer_id", (F.col("cust_prev_events") + 1).alias("position"))


@query("ord_3_chronological", with_ev("SELECT event_id, us AS event_us FROM ev ORDER BY us, event_id"))
def _(t):
    return t.log().select("event_id", "event_us").orderBy("event_us", "event_id")


DISAGREEMENT = """
SELECT event_id, m AS mean_pred,
       sqrt(((p1 - m) * (p1 - m) + (p2 - m) * (p2 - m) + (p3 - m) * (p3 - m)) / 2) AS std_pred,
       p1 AS pred_a, p2 AS pred_b, p3 AS pred_c
FROM (SELECT *, (p1 + p2 + p3) / 3 AS m FROM sco)"""


def prediction_files(t):
    s = t.scores()
    return {name: s.select("event_id", F.col(c).alias("predict"))
            for name, c in (("a", "p1"), ("b", "p2"), ("c", "p3"))}


@query("ord_4_by_disagreement", with_ev(DISAGREEMENT + " ORDER BY std_pred DESC, event_id", LAB, SCO))
def _(t):
    return compare.by_disagreement(compare.disagreement(merge_predictions(prediction_files(t))))


@query("ord_5_most_disputed",
       with_ev(DISAGREEMENT + " ORDER BY std_pred DESC, event_id LIMIT 10", LAB, SCO))
def _(t):
    return compare.most_disputed(compare.disagreement(merge_predictions(prediction_files(t))))


@query("ord_6_preview", with_ev("SELECT event_id, p1 AS predict FROM sco ORDER BY event_id LIMIT 5", LAB, SCO))
def _(t):
    return readers.first_rows(t.scores().select("event_id", F.col("p1").alias("predict")), 5)
