"""Registration of queries, and the event log derived from the given tables."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import micros
from ..operators.lineage import ensure_checkpoint_dir

QUERIES, ORACLE = {}, {}

# dates that play the part of the period borders on the given events
TRAIN_FROM, PRETEST_FROM, TEST_FROM = "2024-01-08", "2024-01-22", "2024-01-24"
SAMPLE_BORDER, RECENT_BORDER, HOLDOUT_START = "2024-01-15", "2024-01-12", "2024-01-18"


class Tables:
    """The given tables, and the views of them the operators work on."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def scratch(self) -> str:
        """A new folder next to the checkpoints, where every executor can write."""
        return f"{ensure_checkpoint_dir(self.spark)}/scratch-{uuid4().hex}"

    def log(self) -> DataFrame:
        """Event log with canonical names."""
        e = self.table("events")
        ts = F.col("ts").cast("timestamp")
        k = F.get_json_object("props", "$.k").cast("int")
        return e.select(
            "event_id", F.col("user_id").alias("customer_id"), ts.alias("event_ts"),
            micros(ts).alias("event_us"), F.to_date(ts).alias("event_date"),
            F.col("value").alias("amt"), F.col("event_type").alias("event_type_nm"),
            F.col("event_type").alias("mcc_code"), k.alias("event_desc"),
            (k % 10).alias("channel_indicator_sub_type"),
            F.unix_date(F.to_date(ts)).cast("bigint").alias("session_id"),
        )

    def labels(self) -> DataFrame:
        """Sparse labels: large errors are red, medium ones yellow, the rest unlabelled."""
        e = self.table("events").where((F.col("event_type") == "error") & (F.col("value") > 30))
        return e.select("event_id", F.when(F.col("value") > 60, 1).otherwise(0)
                        .cast("bigint").alias("target"))

    def periods(self, df: DataFrame | None = None) -> dict[str, DataFrame]:
        """The log cut into its four periods."""
        df = self.log() if df is None else df
        at = F.col("event_ts")
        cut = {n: F.lit(d).cast("timestamp") for n, d in
               (("train", TRAIN_FROM), ("pretest", PRETEST_FROM), ("test", TEST_FROM))}
        return {
            "pretrain": df.where(at < cut["train"]),
            "train": df.where((at >= cut["train"]) & (at < cut["pretest"])),
            "pretest": df.where((at >= cut["pretest"]) & (at < cut["test"])),
            "test": df.where(at >= cut["test"]),
        }

    def period_log(self) -> DataFrame:
        """The log with period, target and the three-way raw target."""
        from ..functions.labels import three_way
        at = F.col("event_ts")
        period = (F.when(at < F.lit(TRAIN_FROM).cast("timestamp"), "pretrain")
                  .when(at < F.lit(PRETEST_FROM).cast("timestamp"), "train")
                  .when(at < F.lit(TEST_FROM).cast("timestamp"), "pretest").otherwise("test"))
        df = self.log().withColumn("period", period).join(self.labels(), "event_id", "left")
        return df.withColumn("train_target_raw", three_way())

    def raw(self) -> DataFrame:
        """Events in the raw layout: text timestamps to the second, untyped columns."""
        e = self.table("events")
        ts = F.col("ts").cast("timestamp")
        return e.select(
            "event_id", F.col("user_id").alias("customer_id"),
            F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("event_dttm"),
            F.col("value").alias("operaton_amt"), F.col("event_type").alias("mcc_code"),
            F.col("event_type").alias("event_type_nm"),
            F.unix_date(F.to_date(ts)).cast("bigint").alias("session_id"),
            ts.alias("event_ts"),
        )

    def devices(self) -> DataFrame:
        """Device texts derived from the parts table."""
        size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
        return self.table("part").select(
            F.col("p_partkey").alias("event_id"), F.col("p_brand").alias("battery"),
            F.concat(size, F.lit("."), key).alias("device_system_version"),
            F.concat(size, F.lit("x"), key).alias("screen_size"))

    def scores(self) -> DataFrame:
        """Three deterministic scores per event, with a binary label."""
        e = self.log()
        return e.join(self.labels(), "event_id", "left").select(
            "event_id", "event_ts", "event_us",
            (F.col("amt") / 500.0).alias("p1"),
            ((F.col("event_desc") + 1) / 101.0).alias("p2"),
            (F.hour("event_ts") / 23.0).alias("p3"),
            F.coalesce("target", F.lit(0)).cast("bigint").alias("label"), "target")


def query(name: str, sql: str | None = None):
    """Register a query; whole numbers come back as bigint and fractions as double."""

    def register(build):
        def run(spark: SparkSession, base: str) -> DataFrame:
            return plain_types(build(Tables(spark, base)))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return build

    return register


def plain_types(df: DataFrame) -> DataFrame:
    def cast(f):
        if isinstance(f.dataType, T.IntegralType):
            return F.col(f.name).cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            return F.col(f.name).cast("double").alias(f.name)
        return F.col(f.name)

    return df.select(*[cast(f) for f in df.schema])


# --- SQL building blocks ----------------------------------------------------------

EV = """ev AS (
  SELECT event_id, user_id AS customer_id, ts, epoch_us(ts) AS us, value AS amt,
         CAST(ROUND(value * 10000) AS BIGINT) AS units, event_type,
         CAST(props->>'k' AS BIGINT) AS k, CAST(props->>'k' AS BIGINT) % 10 AS sub,
         epoch_us(ts) // 86400000000 AS session_id
  FROM events)"""
LAB = """lab AS (
  SELECT event_id, CAST(CASE WHEN value > 60 THEN 1 ELSE 0 END AS BIGINT) AS target
  FROM events WHERE event_type = 'error' AND value > 30)"""
PER = f"""per AS (
  SELECT ev.*, lab.target,
         CASE WHEN ts < TIMESTAMP '{TRAIN_FROM}' THEN 'pretrain'
              WHEN ts < TIMESTAMP '{PRETEST_FROM}' THEN 'train'
              WHEN ts < TIMESTAMP '{TEST_FROM}' THEN 'pretest' ELSE 'test' END AS period
  FROM ev LEFT JOIN lab USING (event_id)),
lg AS (
  SELECT *, CASE WHEN period = 'train' THEN COALESCE(target, -1) END AS raw FROM per)"""
SCO = """sco AS (
  SELECT event_id, ts, us, amt / 500.0::DOUBLE AS p1, (k + 1) / 101.0::DOUBLE AS p2,
         hour(ts) / 23.0::DOUBLE AS p3, COALESCE(target, 0) AS label, target
  FROM ev LEFT JOIN lab USING (event_id))"""
DEV = """dev AS (
  SELECT p_partkey AS event_id, p_brand AS battery,
         p_size || '.' || p_partkey AS device_system_version,
         p_size || 'x' || p_partkey AS screen_size FROM part)"""


def with_ev(body: str, *more: str) -> str:
    return "WITH " + ", ".join((EV,) + more) + "\n" + body


def md5_number(*parts: str) -> str:
    text = parts[0] if len(parts) == 1 else " || '|' || ".join(parts)
    return f"CAST('0x' || substr(md5(CAST({text} AS VARCHAR)), 1, 8) AS BIGINT)"
